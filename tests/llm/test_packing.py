import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weir.llm.packing import best_fit_plan, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, size):
    """Sequences are gapless and not longer than ``size``; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def one_by_one(lengths, size):
    """Best-fit decreasing, one piece after the other."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            best = min(fits, key=lambda i: free[i])
            free[best] -= n
        else:
            free.append(size - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_good_as_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 7, 33, 50, 51, 64, rng.randint(1, 100), 100]) for _ in range(400)]
    plan = best_fit_plan(Counter(lengths), 100)
    placed = Counter()
    room = defaultdict(int)
    for length, low, high, each, sequence, used in plan:
        placed[length] += high - low
        for rank in range(low, high):
            room[sequence + (rank - low) // each] += length
    assert placed == Counter(lengths) and max(room.values()) <= 100 and len(room) == one_by_one(lengths, 100)


@pytest.mark.parametrize("share", [1, 7, 10_000])
def test_every_piece_gets_its_own_place(spark, tmp_path, share):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 5, 5, rng.randint(1, 50)])) for i in range(500)] + [(3, 5)] * 4 + [(None, 7)] * 2
    spark.createDataFrame(rows, "id long, length long").write.parquet(str(tmp_path / "p"))
    got = pack(spark.read.parquet(str(tmp_path / "p")), 50, ["id"], rows_per_ranking=share).collect()
    assert Counter((r.id, r.length) for r in got) == Counter(rows)
    assert check_layout(got, 50) == one_by_one([n for _, n in rows], 50)


def test_documents_are_cut_and_packed(spark):
    text = "Some words, and the 3 others! " * 40
    docs = [(1, text), (1, text), (2, None), (3, ""), (None, "É <|endoftext|> x"), (4, "many " * 30)]
    frame = spark.createDataFrame([(d, t, 9, "n") for d, t in docs], "doc_id long, text string, length int, rank string")
    got = pack_documents(frame, PATH, 64, with_ids=True).collect()
    library, want = Tokenizer.from_file(PATH), []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            cut = ids[at:at + 64]
            want.append((d, k, at, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)), cut))
    assert Counter(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids)) for r in got) == Counter(map(repr, want))
    check_layout(got, 64)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, 64).collect() == []
