"""Encoding, counting and packing against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, encoding, packing, runtime, token_counts


@pytest.fixture(scope="module")
def reference(ranks):
    path, pattern = ranks
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def library(description):
    return Tokenizer.from_file(description[0])


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts)] + [(None, "null id", "x"), (4, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")  # an extra column with a clashing name


def test_encoding_round_trip(docs, ranks, reference):
    got = encoding.round_trip(docs, *ranks).collect()
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        ids = np.array(reference.encode_ordinary(text), "<u4")
        want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want


def test_encode_then_decode(docs, ranks, reference):
    encoded = encoding.encode(docs, *ranks)
    assert all(r.ids == reference.encode_ordinary(r.text or "") for r in encoded.join(docs.drop("ids").where("doc_id <> 4"), "doc_id").collect())
    back = encoding.decode(encoded, *ranks)
    assert Counter(bytes(r.data).decode() for r in back.collect()) == Counter(r.text or "" for r in docs.collect())


def test_counts(docs, description, library):
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, *description).collect())
    want = Counter()
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 512] += 1
    assert got == want


def test_empty_tables(docs, ranks, description):
    none = docs.limit(0)
    assert encoding.round_trip(none, *ranks).count() == token_counts.count_tokens(none, *description).count() == packing.pack_documents(none, *description).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))), max_size=4))
def test_both_merge_methods_agree_with_the_library(texts):
    import public_tokenizers

    vocab = bpe.from_json(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    library = _library()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = bpe.Encoder(vocab)(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want if texts else len(ids) == 0
    assert bpe.Counter(vocab)(texts).tolist() == list(map(len, want))


_KEPT = []


def _library():
    import public_tokenizers

    if not _KEPT:
        _KEPT.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return _KEPT[0]


def test_memory_of_words_is_bounded(description):
    vocab = bpe.from_json(*description)
    count = bpe.Counter(vocab, limit=10)
    for k in range(30):
        count([f"word{k} other{k}"])
    assert len(count.codes) <= 16


def test_packing_is_exact_and_tight(spark, docs, description, library):
    got = packing.pack_documents(docs, *description, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in docs.where("doc_id <> 4").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        mine = [pieces[r.doc_id, k][0] for k in range(-(-len(ids) // 1024))]
        assert [x for p in mine for x in p.ids] == ids and all(p.length == 1024 for p in mine[1:]) and mine[0].start == 0
        assert all(b.start == a.start + a.length for a, b in zip(mine, mine[1:], strict=False))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plans_use_every_piece_once(lengths):
    plan = packing.plan(lengths, 32)
    used = Counter()
    for parts, times in plan:
        assert sum(parts) <= 32 and times > 0
        for p in parts:
            used[p] += times
    assert used == Counter(lengths)
    table = packing.slots(plan)
    for n in lengths:
        rows = table[table[:, 0] == n]
        assert rows[:, 2].sum() == lengths[n] and (rows[:, 1] == np.cumsum(rows[:, 2]) - rows[:, 2]).all()


def test_a_hot_length_is_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    pieces = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(300).cast("long").alias("length"), (F.col("id") * 7919 % 1009).cast("int").alias("salt"))
    rows = packing.pack(pieces).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 1000 and len({r.sequence_id for r in rows}) == 334


def test_long_texts_in_pieces(odd_texts, description):
    """Cut anywhere a lone space allows, texts give the same tokens."""
    vocab = bpe.from_json(*description)
    for text in [t for t in odd_texts if t] + ["It's  a test , isn't it ?  12 3 \n x" * 40]:
        for limit in (1, 7, 100):
            cut = list(runtime.pieces(text, limit))
            assert "".join(cut) == text
            assert [p for c in cut for p in vocab.pretokens(c)] == vocab.pretokens(text)
    texts = ["a b c " * 50, "", "x", "d e " * 100]
    held = list(runtime.parts(texts, 40))
    assert ["".join(p for rows, ps in held for r, p in zip(rows, ps, strict=True) if r == i) for i in range(4)] == texts
    assert max(sum(map(len, ps)) for _, ps in held) <= 44


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=60))
def test_ascii_texts_split_alike(text):
    import public_tokenizers

    vocab = bpe.from_json(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert vocab.split_ascii.findall(text) == vocab.split.findall(text)
