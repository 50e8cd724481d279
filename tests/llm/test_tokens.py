"""Encoders, length histogram, packed files and sequence packing against plain token ids."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from pulsegauge.llm import lengths, packed, packing
from pulsegauge.llm.queries import BYTE_VOCABULARY, LLM_QUERIES, WORD_VOCABULARY
from pulsegauge.llm.tokens import encoder
from tests.llm.conftest import SF_DIR

PLAIN = {}


def plain_ids(path, text):
    if path not in PLAIN:
        PLAIN[path] = Tokenizer.from_file(path)
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "The fox, it's here.\nNext line", "  two  spaces ", "\n\n\nlines\n\n", "tab\there \t x", "don't!?, a.b, c.,d.", "über Straße, ÇA.",
    "12,345.67 x y z", "a\x1cb\x85c", "é, é.", "<|endoftext|> x", "a <|endoftext|>, <unk>x <UNK> </s>y", "日本語、テキスト. 中文,", "x \n y\n z", "\n", " ", "A. B, C'S.",
]


@pytest.mark.parametrize("path", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_encoder_equals_whole_text_encoding(path):
    for text in TEXTS:
        assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == plain_ids(path, text), text


@pytest.mark.parametrize("path", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_every_letter_before_a_sign(path):
    """Letters that the normaliser takes apart, as a dotted capital I or nukta letters, end in a mark that joins a sign."""
    letters = [c for c in map(chr, range(0x20000)) if c.isalpha() and not (0x3500 < ord(c) < 0x9F00 or 0xAC80 < ord(c) < 0xD700)]
    for low in range(0, len(letters), 64):
        text = " ".join(f"x{c}, {c}. a{c}" for c in letters[low : low + 64])
        assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == plain_ids(path, text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aBé1'., \n\t !s日σΣ́")), max_size=24))
def test_encoder_on_any_text(text):
    for path in (BYTE_VOCABULARY, WORD_VOCABULARY):
        assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == plain_ids(path, text)


@pytest.mark.parametrize("bits", [1, 3, 8, 12, 16, 17, 20, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    data = packed.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    for first, count in ((0, 1000), (17, 300), (999, 1), (500, 0)):
        assert packed.unpack(data, bits, first, count).tolist() == ids[first : first + count].tolist()
    with pytest.raises(ValueError):
        packed.pack(np.array([1 << bits], np.uint64), bits)


@pytest.mark.parametrize("bits", [12, 16])
def test_file_random_access(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 5, 70_000, 1, 200_000, 3)]
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "f")) as out:
        writer = packed.PackedWriter(out, bits)
        for i, ids in enumerate(docs):
            writer.add(None if i == 3 else i, ids)
        writer.close()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        file = packed.PackedFile(source)
        assert file.n_docs == len(docs) and file.known.tolist() == [True, True, True, False, True, True]
        for i in (4, 0, 2, 5, 3, 1):
            assert file.document(i).tolist() == docs[i].tolist()
        whole = np.concatenate(docs)
        assert file.ids(65_000, 140_000).tolist() == whole[65_000:205_000].tolist()
    (tmp_path / "cut").write_bytes((tmp_path / "f").read_bytes()[:-4])
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "cut")) as source, pytest.raises(ValueError):
        packed.PackedFile(source)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected_packed(rows):
    """Lengths and checksums by document; starts are checked as running sums in file order."""
    return Counter((r["doc_id"], len(ids := plain_ids(BYTE_VOCABULARY, r["text"]) + [2]), crc(ids)) for r in rows)


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_packed_round_trip(spark, request, name):
    docs = request.getfixturevalue(name)
    got = sorted(packed.packed_round_trip(docs, BYTE_VOCABULARY, 2).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected_packed(docs.collect())
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)


def test_empty_tables(spark, no_docs):
    assert packed.packed_round_trip(no_docs, BYTE_VOCABULARY, 2).count() == 0
    assert packing.pack_documents(no_docs, WORD_VOCABULARY).count() == 0
    assert lengths.length_table(lengths.length_histogram(no_docs, BYTE_VOCABULARY)).count() == 0
    assert lengths.truncated_total(lengths.length_histogram(no_docs, BYTE_VOCABULARY), 9).first()["tokens"] == 0


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_lengths_answer_every_limit(request, name):
    docs = request.getfixturevalue(name)
    sizes = np.array([len(plain_ids(BYTE_VOCABULARY, r["text"])) for r in docs.collect()])
    histogram = lengths.length_histogram(docs, BYTE_VOCABULARY)
    table = lengths.length_table(histogram).cache()
    for r in table.collect():
        n = r["n_tokens"]
        want = ((sizes == n).sum(), n * (sizes == n).sum(), (sizes >= n).sum(), sizes[sizes >= n].sum(), np.minimum(sizes, n).sum(), (sizes <= n).sum())
        assert tuple(r)[1:] == want
    for limit in (0, 100, 1 << 20):
        r = lengths.truncated_total(histogram, limit).first()
        assert tuple(r) == (len(sizes), sizes.sum(), np.minimum(sizes, limit).sum(), (sizes > limit).sum())
    ordered = np.sort(sizes)
    for r in lengths.length_quantiles(table, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == ordered[int(np.ceil(r["share"] * len(sizes))) - 1]


def check_packing(rows, docs, capacity):
    pieces, sequences = Counter(), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for r in docs:
        ids = plain_ids(WORD_VOCABULARY, r["text"]) + [0]
        for low in range(0, len(ids), capacity):
            part = ids[low : low + capacity]
            want[r["doc_id"], low // capacity, low, len(part), crc(part)] += 1
    assert pieces == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_packing_is_whole_and_tight(request, name):
    docs = request.getfixturevalue(name).collect()
    used = check_packing(packing.pack_documents(request.getfixturevalue(name), WORD_VOCABULARY).collect(), docs, 2048)
    sizes = [len(plain_ids(WORD_VOCABULARY, r["text"])) + 1 for r in docs]
    rests = [s % 2048 for s in sizes if s % 2048]
    assert used <= sum(s // 2048 for s in sizes) + packing.least_bins(rests, 2048) * 1.03 + 1


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(3)
    lengths_ = rng.integers(1, 100, 200).tolist()
    a, b = (packing._filled(rng.permutation(200).tolist(), lengths_, 100) for _ in range(2))
    child = packing.crossover(a, b, lengths_, 100, rng)
    assert sorted(i for items in child for i in items) == list(range(200))
    assert all(sum(lengths_[i] for i in items) <= 100 for items in child)
    assert len(packing.evolve(lengths_, [], 100, 1)) <= min(len(a), len(b))


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    items = spark.range(400).selectExpr("id AS item", "1 + pmod(id * 7919, 64) AS length")
    rows = packing.assign_sequences(items, 64).join(items, "item").collect()
    assert sorted(r["item"] for r in rows) == list(range(400))
    fills = defaultdict(list)
    for r in rows:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fills.values():
        assert sorted(o for o, _ in parts) == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
        assert sum(n for _, n in parts) <= 64


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in LLM_QUERIES}
    assert LLM_QUERIES["op8_token_counts"](spark, SF_DIR).count() > 0
