import base64
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from weir.llm import byte_bpe, words
from weir.llm.token_counts import token_counts, truncated

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", "  ", "Don't  you'RE 'll'dx they'r", "<|endoftext|>x <|endof <|startoftext|>", "ÉcOLE İstanbul ΣΑΣ éa á̧ ́x",
    "漢字かな 한국 🤖🏽", "é" * 45 + " x", "x_y__z 123 4.5\x1c\x1dq \x85b\xa0c", "ſßẞK" + "x" * 300 + "tionthe'", "ẛ̣ ﬁ ½ ²x", "\x00 \x01",
    "<unk> ▁ a  \n\n\t b", "inhaedble thheouble De%%% êeux*** !!'s '''"]


@pytest.fixture(scope="module")
def texts(spark, data):
    return ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()][:60]


def test_word_ids_and_counts_are_the_librarys(texts):
    bpe, library = words.load(WORDS), Tokenizer.from_file(WORDS)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert memoryview(bpe.encode(t)).cast("I").tolist() == ids
        assert bpe.count(t) == len(ids)


def test_every_prefix_has_its_exact_count(texts):
    bpe, library = words.load(WORDS), Tokenizer.from_file(WORDS)
    for t in texts[:25]:
        t = t[:400]
        want = [len(library.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]
        assert bpe.prefix_counts(t).tolist() == want
        for limit in (0, 1, 5, 40):
            assert bpe.fitting(t, limit) == max(p for p, n in enumerate(want) if n <= limit)


def drawn(rng, signs, size):
    return "".join(rng.choice(signs) for _ in range(size))


@pytest.mark.parametrize("long", [4, 64])
def test_prefixes_of_texts_that_normalising_moves(monkeypatch, long):
    monkeypatch.setattr(words, "_LONG", long)
    bpe, library, rng = words.WordBpe(WORDS), Tokenizer.from_file(WORDS), random.Random(long)
    kinds = [["a", "e", "r", "'", "s", "\u0301", "\u0327", "l", "v", "!"], ["か", "\u3099", "は", "\u309a"],
             ["\u1100", "\u1161", "\u11a8", "한", "가"], ["<|endoftext|>", "<|endof", "e", "\u0301", "漢", "<", "|>"],
             ["İ", "Σ", "\u0345", "\u0958", "\u2028", "\x1c", " ", "7", "Å", "<", "\u0338", "”", "—"], ["the ", "is", "’s ", "漢字", "”"]]
    for n in range(120):
        text = drawn(rng, kinds[n % 6] if n < 90 else sum(kinds, []), rng.choice([3, 12, 60, 150]))
        want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert bpe.prefix_counts(text).tolist() == want, repr(text)
        assert bpe.count(text) == want[-1]
        for limit in (0, 1, 2, 7, 30, rng.randrange(want[-1] + 2)):
            assert bpe.fitting(text, limit) == max(p for p, c in enumerate(want) if c <= limit), (repr(text), limit)


def test_long_texts_without_spaces_are_encoded_once():
    class Counted:
        def __init__(self, library):
            self.library, self.letters = library, 0

        def __getattr__(self, name):
            return getattr(self.library, name)

        def encode(self, text, **kw):
            self.letters += len(text)
            return self.library.encode(text, **kw)

    bpe = words.WordBpe(WORDS)
    bpe.library = Counted(bpe.library)
    rng = random.Random(3)
    for text in (drawn(rng, "漢字文書日本語長", 20_000), drawn(rng, ["か", "か\u3099", "き"], 20_000)):
        counts = bpe.prefix_counts(text)
        assert bpe.count(text) == counts[-1] == len(bpe.library.library.encode(text, add_special_tokens=False).ids)
        assert bpe.fitting(text, 2048) == max(p for p, n in enumerate(counts) if n <= 2048)
    assert bpe.library.letters <= 100_000


def test_counts_stay_right_when_memory_is_given_back():
    bpe, library = words.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    bpe.word_counts.limit = 3
    text = "the other thing and another thing, then the other again"
    assert bpe.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark):
    docs = [(1, "one two three"), (1, "one two three"), (2, None), (None, "a" * 50), (3, "word " * 30)]
    frame = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, n_tokens int, fit_chars string")
    got = sorted((tuple(r) for r in token_counts(frame, WORDS, 10, prefixes=True).collect()), key=repr)
    library = Tokenizer.from_file(WORDS)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = []
    for d, t in docs:
        t = t or ""
        counts = [count(t[:p]) for p in range(len(t) + 1)]
        want.append((d, len(t.encode()), counts[-1], counts[-1] > 10, max(p for p, n in enumerate(counts) if n <= 10), counts))
    assert got == sorted(want, key=repr)
    cut = truncated(token_counts(frame.filter("doc_id = 3"), WORDS, 10), frame.filter("doc_id = 3")).first()
    assert count(cut.text) == 10
    assert token_counts(frame.limit(0), WORDS, 10).collect() == []


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_written_model_encodes_as_tiktoken(texts, tik):
    bpe = byte_bpe.load(BYTES, public_tokenizers.PATTERN)
    for t in texts:
        ids = bpe.encode(t)
        assert ids == tik.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_model_is_a_sentencepiece_model():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    model = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.model_bytes(tokens))
    assert model.get_piece_size() == 259 and model.unk_id() == 258 and model.encode("abcab") == [257, 256]


def test_texts_encoded_and_decoded(spark, tik):
    docs = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (None, "é\x00🤖" * 2000)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, ids string")
    encoded = byte_bpe.encode_texts(frame, BYTES, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, r.ids) for r in encoded.collect()) == sorted((d or 0, tik.encode_ordinary(t or "")) for d, t in docs)
    back = byte_bpe.decode_ids(encoded, BYTES, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back) == sorted((d or 0, (t or "").encode()) for d, t in docs)
    digests = byte_bpe.encode_texts(frame, BYTES, public_tokenizers.PATTERN, digests=True).filter("doc_id = 2").first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(digests) == (2, 0, empty, empty)
    assert byte_bpe.encode_texts(frame.limit(0), BYTES, public_tokenizers.PATTERN).collect() == []


def test_encoding_leaves_the_counting_tables_out():
    bpe = words.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.encode("Some words, 3 of them")
    assert not {"inner", "named", "endings", "longest"} & bpe.__dict__.keys()
    assert bpe.count("Some words, 3 of them") * 4 == len(bpe.encode("Some words, 3 of them"))
