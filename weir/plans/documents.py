"""Documents: files in a table, chunks, statistics, labels, product texts and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.fixed_values import EVENT_CLASSES
from weir.operators import bayes, documents as docs_ops
from weir.operators.lexicon import EVENT_LEXICON, SENTIMENT, lexicon_classify, lexicon_sentiment
from weir.operators.sampling import hash_split
from weir.registry import query
from weir.session import pinned
from weir.tables import load, spread

FOLDER = "archive/"


@query("doc_file_table", f"""
  SELECT source || ' ' || text AS content, '{FOLDER}' || doc_id AS file_path, doc_id || '.txt' AS file_name,
    CAST(length(source || ' ' || text) AS BIGINT) AS file_size, n_chars AS file_modification_time
  FROM documents WHERE length(trim(source || ' ' || text)) > 0""")
def doc_file_table(spark, d) -> DataFrame:
    files = docs_ops.file_table(load(spark, d, "documents"), ["source", "text"], "doc_id", FOLDER, "n_chars")
    return files.select("content", "metadata.*")


_TOKENS = r"[x FOR x IN regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') IF x <> '']"


@query("chunk_documents", f"""
  WITH t AS (SELECT doc_id, lang, {_TOKENS} AS w FROM documents),
  p AS (SELECT *, CASE WHEN len(w) > 500 THEN 1 + CAST(ceil((len(w) - 500) / 425.0) AS BIGINT) WHEN len(w) > 0 THEN 1 ELSE 0 END AS n FROM t),
  c AS (SELECT doc_id, lang, i, array_to_string(w[i * 425 + 1 : i * 425 + 500], ' ') AS chunked_text
        FROM (SELECT *, unnest(range(n)) AS i FROM p))
  SELECT doc_id, lang, CAST(i AS INTEGER) AS chunk_no, chunked_text, md5(chunked_text) AS chunk_id FROM c""")
def chunk_documents(spark, d) -> DataFrame:
    return docs_ops.chunk(spread(load(spark, d, "documents").select("doc_id", "lang", "text")), "text")


@query("text_stats", f"""
  SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n_words,
    CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]')) AS INTEGER) AS n_tokens,
    CAST(length(text) AS INTEGER) AS n_characters FROM documents""")
def text_stats(spark, d) -> DataFrame:
    return docs_ops.text_stats(spread(load(spark, d, "documents").select("doc_id", "text")), "text")


STOP_WORDS = {
    "english": ["the", "of", "and", "to", "that", "with", "this"],
    "german": ["der", "die", "und", "das", "nicht", "mit", "ist"],
    "french": ["le", "les", "des", "une", "dans", "qui", "est"],
    "spanish": ["el", "los", "las", "por", "con", "una", "del"],
}
_SPLIT = r"regexp_split_to_array(lower(text), '[^\p{L}]+')"
_COUNT = lambda words: f"len([x FOR x IN {_SPLIT} IF x IN ({', '.join(repr(w) for w in words)})])"


@query("lexicon_classify", f"""
  WITH s AS (SELECT doc_id, [{', '.join(_COUNT(w) for w in STOP_WORDS.values())}] AS n FROM documents)
  SELECT doc_id, CASE WHEN list_max(n) > 0 THEN {list(STOP_WORDS)}[list_position(n, list_max(n))] ELSE 'other' END AS event_class FROM s""")
def lexicon_labels(spark, d) -> DataFrame:
    rows = spread(load(spark, d, "documents").select("doc_id", "text"))
    return lexicon_classify(rows, "text", STOP_WORDS).drop("text")


@query("event_classes", f"""
  SELECT CASE o_orderkey % 8 WHEN 0 THEN 'gamma-ray burst' WHEN 1 THEN 'fast X-ray transient' WHEN 2 THEN 'gravitational wave' WHEN 3 THEN 'neutrino'
    WHEN 4 THEN 'supernova' WHEN 5 THEN 'optical transient' WHEN 6 THEN 'other' ELSE 'neutrino' END AS event_class, count(*) AS n
  FROM orders GROUP BY 1""")
def event_classes(spark, d) -> DataFrame:
    """Notices labelled with the seven published classes."""
    orders = load(spark, d, "orders").select("o_orderkey")
    said = ["GRB seen, a burst", "An X-ray transient", "LIGO merger", "A neutrino track event", "Supernova SN 2024",
            "optical counterpart found", "nothing of note", "a burst of neutrinos, one neutrino"]
    notice = F.concat(F.element_at(F.array(*[F.lit(t) for t in said]), (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit(" no. "), "o_orderkey")
    labelled = lexicon_classify(orders.withColumn("notice", notice), "notice", EVENT_LEXICON, default=EVENT_CLASSES[-1])
    return labelled.groupBy("event_class").agg(F.count(F.lit(1)).alias("n"))


PRODUCT_KINDS = {"fastener": ["bolt", "rod"], "machine part": ["gear", "widget"], "forging": ["anvil", "plate"], "jewellery": ["ring"]}


@query("product_kinds", f"""
  SELECT p_partkey AS product_id, CASE {' '.join(
      f"WHEN list_has_any(string_split(p_name, ' '), [{', '.join(map(repr, ws))}]) THEN '{k}'" for k, ws in PRODUCT_KINDS.items())}
    ELSE 'other' END AS kind FROM part""")
def product_kinds(spark, d) -> DataFrame:
    """One of five kinds for the name of every product."""
    names = load(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_name")
    return lexicon_classify(names, "p_name", PRODUCT_KINDS, alias="kind").drop("p_name")


@query("lexicon_sentiment", f"""
  WITH s AS (SELECT conv_id, turn, CAST({_COUNT(SENTIMENT['positive'])} - {_COUNT(SENTIMENT['negative'])} AS INTEGER) AS sentiment_score FROM conversations)
  SELECT *, CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM s""")
def moods(spark, d) -> DataFrame:
    rows = spread(load(spark, d, "conversations").select("conv_id", "turn", "text"))
    return lexicon_sentiment(rows, "text").drop("text")


# labels learnt from labelled rows

_WORDS = r"[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+') IF x <> '']"
_PART = "CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4)) AS INTEGER) < 52428 THEN 'train' ELSE 'test' END"


def _bayes_sql(rows: str) -> str:
    """Naive Bayes in SQL over ``rows`` (doc_id, text, label, split), fitted on the labelled rows to train on."""
    return f"""
  WITH rows AS ({rows}),
  w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM rows) GROUP BY ALL),
  t AS (SELECT w.*, label FROM w JOIN rows USING (doc_id) WHERE split = 'train' AND label IS NOT NULL),
  known AS (SELECT label, word, sum(n) AS n FROM t GROUP BY ALL),
  size AS (SELECT count(DISTINCT word) AS v FROM known),
  prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM rows WHERE split = 'train' AND label IS NOT NULL)) AS p
            FROM rows WHERE split = 'train' AND label IS NOT NULL GROUP BY label),
  total AS (SELECT p.label, p.p, coalesce(sum(k.n), 0) AS n FROM prior p LEFT JOIN known k ON k.label = p.label GROUP BY ALL),
  scores AS (
    SELECT w.doc_id, total.label, sum(w.n * (coalesce(ln(k.n + 1), 0) - ln(total.n + v + 1))) AS s
    FROM w CROSS JOIN total CROSS JOIN size LEFT JOIN known k ON k.word = w.word AND k.label = total.label GROUP BY ALL),
  best AS (
    SELECT rows.doc_id, split, rows.label, total.label AS predicted FROM rows CROSS JOIN total
    LEFT JOIN scores ON scores.doc_id = rows.doc_id AND scores.label = total.label
    QUALIFY row_number() OVER (PARTITION BY rows.doc_id ORDER BY round(coalesce(s, 0) + p, 6) DESC, total.label) = 1)"""


def _split(docs: DataFrame) -> DataFrame:
    return hash_split(docs, "doc_id", {"train": 0.8, "test": 0.2})


def learnt_labels(rows: DataFrame) -> DataFrame:
    """``doc_id, split, label, predicted`` of every row, fitted on the labelled rows to train on."""
    model = bayes.fit(rows.filter("split = 'train'"), "doc_id", "text", "label")
    named = rows.select(F.col("doc_id").alias("_id"), "split", "label")
    found = model.classify(rows, "doc_id", "text", "predicted")
    return found.join(named, found["doc_id"] == named["_id"]).select("doc_id", "split", "label", "predicted")


@query("learnt_language", _bayes_sql(f"SELECT doc_id, text, lang AS label, {_PART} AS split FROM documents") + """
  SELECT doc_id, split, label, predicted FROM best""")
def learnt_language(spark, d) -> DataFrame:
    """The language of every document, learnt from four fifths of them; no word list."""
    docs = load(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return learnt_labels(pinned(_split(docs), "texts"))


_MOOD = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END"


@query("learnt_sentiment", _bayes_sql(f"SELECT d.doc_id, text, {_MOOD} AS label, {_PART.replace('doc_id', 'd.doc_id')} AS split FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id") + """
  SELECT doc_id, split, label, predicted FROM best""")
def learnt_sentiment(spark, d) -> DataFrame:
    """The mood of every document, learnt from the labelled ones: toxic texts are negative, good ones positive."""
    moods = load(spark, d, "labels").select("doc_id", F.expr(_MOOD).alias("label"))
    docs = load(spark, d, "documents").select("doc_id", "text").join(moods, "doc_id", "left")
    return learnt_labels(pinned(_split(docs), "texts"))


@query("learnt_label_report", _bayes_sql(f"SELECT doc_id, text, lang AS label, {_PART} AS split FROM documents") + """,
  commonest AS (SELECT label AS c FROM rows WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
  SELECT split, label, count(*) AS n, count(*) FILTER (predicted = label) AS correct, count(*) FILTER (label = c) AS correct_by_commonest
  FROM best, commonest WHERE label IS NOT NULL GROUP BY split, label""")
def learnt_label_report(spark, d) -> DataFrame:
    """Per part and language: texts, right labels, and right ones if all had the commonest label."""
    scored = pinned(learnt_language(spark, d), "scored")
    common = scored.filter("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").first()
    return scored.filter("label IS NOT NULL").groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("correct"),
        F.count_if(F.col("label") == common["label"]).alias("correct_by_commonest"))


def catalog(spark, d) -> DataFrame:
    """Parts as shop products."""
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
        F.col("p_size").alias("price"), F.when(F.col("p_size") >= 40, "Discontinued").otherwise("In Stock").alias("availability"),
        (F.col("p_size") % 3 + 1).alias("warranty_years"), F.concat(F.lit("Made by "), "p_brand").alias("description"))


_CATALOG = """(SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_size AS price, p_brand,
  CASE WHEN p_size >= 40 THEN 'Discontinued' ELSE 'In Stock' END AS availability, p_size % 3 + 1 AS warranty_years FROM part)"""


def product_docs(spark, d) -> DataFrame:
    return catalog(spark, d).select(
        "product_id", "product_name", F.col("category").alias("product_category"), docs_ops.product_text().alias("indexed_doc"))


@query("product_doc_build", f"""
  SELECT product_id, product_name, category AS product_category, product_name || ' | Category: ' || category || ' | Price: $' || price ||
    ' | Availability: ' || availability || ' | Warranty: ' || warranty_years || ' year(s). Made by ' || p_brand AS indexed_doc FROM {_CATALOG}""")
def product_doc_build(spark, d) -> DataFrame:
    return product_docs(spark, d)


@query("policy_conflicts", """
  SELECT p_name AS topic, CAST(min(p_size % 3 * 30) AS INTEGER) AS least_days, CAST(max(p_size % 3 * 30) AS INTEGER) AS most_days, count(*) AS n_rows
  FROM part GROUP BY 1 HAVING min(p_size % 3) <> max(p_size % 3)""")
def policy_conflicts(spark, d) -> DataFrame:
    """Product names whose rows promise different return periods."""
    terms = load(spark, d, "part").select(F.col("p_name").alias("topic"), (F.col("p_size") % 3 * 30).alias("days"))
    return docs_ops.contradicting_terms(terms)


@query("consistency_audit", f"""
  WITH a AS (SELECT product_id, warranty_years, p_brand = 'Brand#7' AND availability = 'Discontinued' AS stock_conflict,
    CASE WHEN category = 'PROMO' THEN 3 ELSE warranty_years END AS claimed_years FROM {_CATALOG})
  SELECT product_id, stock_conflict, claimed_years <> warranty_years AS warranty_conflict, CAST(claimed_years AS INTEGER) AS claimed_years, warranty_years
  FROM a WHERE stock_conflict OR claimed_years <> warranty_years""")
def consistency_audit(spark, d) -> DataFrame:
    """Documents of one brand claim stock, those of one category claim three years."""
    text = F.col("indexed_doc")
    promo = F.when(F.col("product_category") == "PROMO", F.regexp_replace(text, r"Warranty: \d+ year", "Warranty: 3 year")).otherwise(text)
    stock = F.when(text.contains("Made by Brand#7") & text.endswith("Brand#7"),
                   F.concat(promo, F.lit(" This product is in stock and available now."))).otherwise(promo)
    return docs_ops.consistency_audit(product_docs(spark, d).withColumn("indexed_doc", stock), catalog(spark, d))
