import random
import re

from weir.llm.quotations import conversations, parsed


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "n", 1) for c, t, r, x in rows],
                                 "conv_id long, turn long, role string, text string, c string, rank int").repartition(3)


def got(spark, rows):
    return sorted((tuple(r) for r in conversations(table(spark, rows)).collect()), key=repr)


def test_levels_and_own_words(spark):
    text = ("On Monday A wrote:\n> > the very first words of all\n> and the second, longer words.\n> They go\n> on here.\n\n"
            "My own answer is this one.\nOn a day nobody wrote:\nmore of mine")
    row = parsed(spark.createDataFrame([(1, 1, text)], "c long, t long, body string")).first()
    assert row.own == "My own answer is this one.\nOn a day nobody wrote:\nmore of mine"
    assert sorted(p.level for p in row.passages) == [0, 0, 1, 1, 2]


def test_branches_are_put_in_reply_order(spark):
    rows = [
        (1, 0, "user", "What is the best way to learn this?"), (1, 1, "a", "Read the book that I gave you."),
        (1, 2, "b", "I do not quite agree with that."), (1, 3, "c", "> What is the best way to\n> learn this?\nJust try it out now."),
        (1, 4, "d", "> > What is the best way to learn this?\n> READ the book, that I gave you!\nWhich book do you mean?"),
        (1, 5, "e", "Nothing quoted here at all."), (1, 6, "f", ">unknown words that nobody wrote\nyes"), (2, 3, "u", "hi"), (2, 9, "a", "> hi\nhello")]
    order = {(c, t): (p, x, r) for c, p, t, _, x, r in got(spark, rows)}
    assert order[1, 0] == (0, "What is the best way to learn this?", None)
    assert order[1, 1] == (1, "Read the book that I gave you.", 0)
    assert order[1, 2] == (2, "I do not quite agree with that.", 1)
    assert order[1, 4] == (3, "Which book do you mean?", 1)
    assert order[1, 5] == (4, "Nothing quoted here at all.", 4)
    assert order[1, 6] == (5, "yes", 5)
    assert order[1, 3] == (6, "Just try it out now.", 0)
    assert order[2, 3] == (0, "hi", None) and order[2, 9] == (1, "hello", 3)


def test_short_quotations_find_their_message(spark):
    rows = [
        (1, 0, "u", "Hello all. Which version?"), (1, 1, "a", "Thank you!"), (1, 2, "b", "Something else was said here."),
        (1, 3, "c", "> Which version?\n4.1"), (1, 4, "d", "Thank you!"), (1, 5, "e", "No more."), (1, 6, "f", "> Thank you!\nwelcome"),
        (1, 7, "g", "> Thank you!\n> Something else was said here.\nok"), (1, 8, "h", "> > Something else was said here.\n> 4.1\nold"),
        (1, 9, "i", "> Not said\nyes"), (2, 0, "u", "你好。請問這是哪個版本？謝謝。"), (2, 1, "a", "你好！"), (2, 2, "b", "> 請問這是\n> 哪個版本？\n四"),
        (2, 3, "c", "> 謝謝\n不客氣"), (2, 4, "d", "> 你好\n早")]
    rows += [(3, t, "u", "ok") for t in range(40)] + [(3, 100 + t, "u", f"> OK.\nn{t}") for t in range(3)]
    reply = {(c, t): r for c, p, t, _, x, r in got(spark, rows)}
    assert {t: reply[1, t] for t in range(3, 10)} == {3: 0, 4: 3, 5: 4, 6: 4, 7: 2, 8: 3, 9: 8}
    assert {t: reply[2, t] for t in range(2, 5)} == {2: 0, 3: 0, 4: 1}
    assert [reply[3, 100 + t] for t in range(3)] == [39, 39, 39]


def brute(rows):
    """One message after the other; rows of (conv, turn) are distinct here."""
    words = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    out, first = [], {}
    said = {(c, t): x for c, t, _, x in rows}
    for conv in {r[0] for r in rows}:
        turns = sorted(t for c, t in said if c == conv)
        parent, own = {}, {}
        for i, t in enumerate(turns):
            lines = said[conv, t].split("\n")
            own[t] = "\n".join(l for l in lines if not l.startswith(">")) if any(l.startswith(">") for l in lines) else said[conv, t]
            quoted = [words(l[1:]) for l in lines if l.startswith(">")]
            origin = [o for q in quoted for o in turns[:i] if any(words(l) == q for l in own[o].split("\n"))][:1]
            parent[t] = origin[0] if origin else (turns[i - 1] if i else None)
        left, n = [turns[0]], 0
        while left:
            t = left.pop()
            first[conv, t] = n
            n += 1
            left += sorted((s for s in turns if parent[s] == t), reverse=True)
        out += [(conv, first[conv, t], t, "r", own[t], parent[t]) for t in turns]
    return sorted(out, key=repr)


def test_random_trees_match_brute_force(spark):
    rng, rows = random.Random(1), []
    for conv in range(12):
        lines = [f"line number {i} of talk {conv} says something." for i in range(40)]
        for i in range(rng.choice([1, 2, 9, 40])):
            quote = f"> {lines[rng.randrange(i)]}\n" if i and rng.random() < 0.5 else ""
            rows.append((conv, i * 3, "r", f"{quote}{lines[i]}"))
    assert got(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, "u", "a b c d"), (1, 0, "u", "a b c d"), (1, None, None, None), (None, 2, "u", "x"), (3, 1, "u", ""), (3, 2, "u", ">\n> \n>>")]
    assert got(spark, rows) == sorted([
        (1, 0, 0, "u", "a b c d", None), (1, 0, 0, "u", "a b c d", None), (1, 1, None, None, None, 0), (None, 0, 2, "u", "x", None),
        (3, 0, 1, "u", "", None), (3, 1, 2, "u", "", 1)], key=repr)
    assert conversations(table(spark, [])).collect() == []


def test_long_text(spark):
    text = "\n".join(f"> line {i} of it is quoted" for i in range(20_000)) + "\nmine"
    assert got(spark, [(1, 1, "u", text)]) == [(1, 0, 1, "u", "mine", None)]


def test_no_python_in_the_plan(spark):
    plan = conversations(table(spark, [(1, 0, "u", "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
