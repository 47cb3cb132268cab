"""Retrieval packing: whole ids, no padding, and neighbours that a plain BM25 search names too."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weir.llm import retrieval_packing
from weir.llm.retrieval_packing import B, K1, Shard, Statistics, _document_counts, _Encoder, encoded, pack_neighbours

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, docs, size):
    """Every id in one piece, sequences without gaps and padding; returns the ids of each sequence."""
    want = Counter((d, tuple(library_ids(t))) for d, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        by_doc[r.doc_id].append((r.start, tuple(r.ids), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length, r.doc_id))
    for doc_id, pieces in by_doc.items():
        expected = Counter({ids: n for (d, ids), n in want.items() if d == doc_id})
        if sum(expected.values()) == 1:
            whole, at = [], 0
            for start, ids, n in sorted(pieces):
                assert start == at
                whole += ids
                at += len(ids)
            assert Counter([tuple(whole)]) == expected and all(n == len(whole) for _, _, n in pieces)
        else:
            assert sum(len(ids) for _, ids, _ in pieces) == sum(len(ids) * n for ids, n in expected.items())
    assert by_doc.keys() == {d for d, _ in docs}
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts, key=lambda p: p[:2]):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
    return by_sequence


WORDS = {k: [f"{k}{w}" for w in ("apple river stone cloud lamp field horse ship paper glass music north".split())] for k in "pqrstuvw"}


def topical(rng, n):
    docs = []
    for i in range(n):
        own, other = WORDS[rng.choice("pqrstuvw")], ["the", "of", "and", "in"]
        docs.append((i, " ".join(rng.choice(own if rng.random() < .6 else other) for _ in range(rng.randint(5, 60)))))
    return docs


@pytest.mark.parametrize("task_tokens, shard_docs", [(1 << 21, 2048), (2000, 30)])
def test_every_id_once_and_no_padding(spark, task_tokens, shard_docs):
    rng = random.Random(3)
    docs = topical(rng, 300) + [(1000, "Long text, 3 words! " * 900), (1001, None), (1002, ""), (None, "É <|endoftext|> x\u001cy"),
                                (1003, "many spaces\u0085here"), (1004, "don't we're 10,000 ＡＢ é")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA + ", lead int, length string")
    rows = pack_neighbours(frame, PATH, 256, 2, with_ids=True, task_tokens=task_tokens, shard_docs=shard_docs).collect()
    by_sequence = check(rows, docs, 256)
    if shard_docs == 2048:
        # one task: one open window at the end
        assert sum(sum(p[1] for p in parts) < 256 for parts in by_sequence.values()) <= 8


def test_windows_share_topics(spark):
    rng = random.Random(4)
    docs = topical(rng, 400)
    topic = {d: Counter(w[0] for w in t.split() if w[0] in WORDS and w in WORDS[w[0]]).most_common(1)[0][0]
             for d, t in docs if any(w[0] in WORDS and w in WORDS[w[0]] for w in t.split())}
    rows = pack_neighbours(spark.createDataFrame(docs, SCHEMA), PATH, 512, 2, with_ids=True).collect()
    same = total = 0
    for parts in check(rows, docs, 512).values():
        kinds = [topic[d] for _, _, d in parts if d in topic]
        total += len(kinds)
        same += max(Counter(kinds).values(), default=0)
    assert same / total > 0.7                  # one of eight by chance


def test_scores_are_bm25(spark):
    docs = topical(random.Random(5), 60)
    ids = {d: library_ids(t)[:-1] for d, t in docs}
    counts = {r.term: r.docs for r in _document_counts(encoded(spark.createDataFrame(docs, SCHEMA), PATH, 2)).collect()}
    seen = Counter(t for x in ids.values() for t in set(x))
    assert {t: n for t, n in counts.items() if t >= 0} == dict(seen)
    shard = Shard([np.array(ids[d]) for d, _ in docs], Statistics(counts))
    mean = sum(map(len, ids.values())) / len(ids)

    def score(q, d):
        tf, out = Counter(ids[d]), 0.0
        for t in set(ids[q]) & set(tf):
            idf = math.log(1 + (len(ids) - seen[t] + .5) / (seen[t] + .5))
            out += idf * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(ids[d]) / mean))
        return out

    shard.unused[[3, 7]] = False
    for seed in (0, 5, 11):
        for _ in range(2):
            got = shard.neighbours(seed)
            assert sorted(got) == [i for i in range(60) if i not in (3, 7)]
            values = [score(seed, int(d)) for d in got]
            assert all(a >= b - 1e-4 for a, b in zip(values, values[1:]))
            shard.shrink()


def test_repeated_rows_and_hot_copies(spark):
    docs = [(5, "the same words again")] * 4 + [(i, "copy of one text " * 5) for i in range(100, 400)] + [(5, "other")]
    rows = pack_neighbours(spark.createDataFrame(docs, SCHEMA), PATH, 64, 2, with_ids=True, task_tokens=1000).collect()
    check(rows, docs, 64)
    assert len({r.sequence_id >> 33 for r in rows}) > 3


def test_empty_table(spark):
    assert pack_neighbours(spark.createDataFrame([], SCHEMA), PATH, 64, 2).collect() == []


def test_chunks_met_before_are_not_encoded_again():
    encoder = _Encoder(PATH)
    chunks, asked = encoder.chunk_ids.__self__, Counter()
    plain = chunks._word
    chunks._word = lambda word: asked.update([word]) or plain(word)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in "aeiou"[:2])
    first = encoder.encode(text)               # 900,000 different words
    assert encoder.encode(text[:600]) == first[:len(encoder.encode(text[:600]))] and max(asked.values()) == 1
    assert len(chunks) <= chunks.limit and len(chunks.older) <= chunks.limit


def test_a_step_looks_each_chunk_up_once():
    encoder, asked = _Encoder(PATH), Counter()
    plain = encoder.chunk_ids
    encoder.chunk_ids = lambda chunk: asked.update([chunk]) or plain(chunk)
    texts = ["The cat, the dog.\nThe end. ", "", "  the dog, the Dog", "10,000 cats&&& dogs&&&"] * 50
    got = encoder.encode_all(pa.array(texts), 2, 2)
    assert [np.frombuffer(t, "<u2").tolist() for t in got.to_pylist()] == [library_ids(t) for t in texts]
    assert max(asked.values()) == 1


def test_signs_behind_words_are_encoded_once():
    chunks, asked = _Encoder(PATH).chunk_ids.__self__, Counter()
    plain = chunks._word
    chunks._word = lambda word: asked.update([word]) or plain(word)
    for word in ("stone", "river", "cloud"):
        assert chunks[word + "&&&"] == b"".join(struct.pack("<I", i) for i in library_ids(word + "&&&")[:-1])
    assert asked["&&&"] == 1


@pytest.mark.parametrize("width", [2, 4])
def test_every_sign_in_steps_of_any_size(monkeypatch, width):
    """Texts with all kinds of letters, spaces and special tokens, beside each other and in steps of their own."""
    signs = [chr(c) for c in range(1, 0x400)] + list("ẞÅ\u2003\u3000漢字😀") + ["<|endoftext|>", "<|", "\x1c", "don't", "'s"]
    texts = [f"{s} a{s}b {s}{s} Cd{s}" for s in signs] + ["", " ", "plain words, here."]
    want = [library_ids(t) for t in texts]
    encoder = _Encoder(PATH)
    for size in (1 << 24, 50):
        monkeypatch.setattr(retrieval_packing, "STEP_BYTES", size)
        column, out = pa.array(["cut off", *texts]).slice(1), []
        for first, last in retrieval_packing._steps(column):
            out += encoder.encode_all(column.slice(first, last - first), 2, width).to_pylist()
        assert [np.frombuffer(t, f"<u{width}").tolist() for t in out] == want
    assert list(retrieval_packing._steps(pa.array([], pa.string()))) == []
    long = "word " * 1000
    monkeypatch.setattr(retrieval_packing, "STEP_BYTES", 2000)
    assert list(retrieval_packing._steps(pa.array(["a", long, "b", "c"]))) == [(0, 1), (1, 4)]
