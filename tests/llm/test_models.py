"""Language ID and the quality classifier: exactness of the kernels, held-out accuracy, odd inputs."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, quality_classifier
from tessera.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return language_id.pieces(PATH)


def cuts(word):
    for k in range(len(word)):
        for places in itertools.combinations(range(1, len(word)), k):
            ends = [0, *places, len(word)]
            yield [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def test_forward_sums_all_segmentations(vocab):
    rng = np.random.default_rng(0)
    table = language_id._normalised(rng.uniform(0, 5, (len(vocab) + 2, 2)), 0.1)
    place = {p: i for i, p in enumerate(vocab.texts)}
    words = ["haus", "the", "ñandú", "x", "straße", "日本"]
    got = language_id.word_scores(words, vocab, table)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            chance = lambda p: table[place[p], k] if p in place else table[-1, k] if len(p) == 1 else 0.0  # noqa: E731, B023
            assert row[k] == pytest.approx(math.log(sum(math.prod(map(chance, c)) for c in cuts("▁" + w))))


def test_expected_counts_by_brute_force(vocab):
    rng = np.random.default_rng(1)
    table = language_id._normalised(rng.uniform(0, 5, (len(vocab) + 2, 2)), 0.1)
    place = {p: i for i, p in enumerate(vocab.texts)}
    words, lang, weight = ["haus", "ñu"], np.array([0, 1]), np.array([2.0, 3.0])
    want = np.zeros(table.shape)
    for w, k, n in zip(words, lang, weight, strict=True):
        index = lambda p: place.get(p, len(vocab) + 1 if len(p) == 1 else len(vocab))  # noqa: E731, B023
        weights = {tuple(c): math.prod(table[index(p), k] for p in c) for c in cuts("▁" + w)}
        for c, v in weights.items():
            for p in c:
                want[index(p), k] += n * v / sum(weights.values())
    assert np.allclose(language_id.expected_counts(words, lang, weight, vocab, table), want)


def test_pieces_are_found(vocab):
    hashes = np.array([language_id.Pieces.key(p) for p in vocab.texts[:500]] + [12345], np.uint64)
    assert vocab.find(hashes).tolist() == [*range(500), len(vocab)]


def test_held_out_accuracy(spark, sf_dir):
    out = QUERIES["op2_language_id"](spark, sf_dir).where("held_out")
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.size(F.split("text", " ")).alias("n"))
    both = out.join(truth, "doc_id").where("n >= 5")
    assert both.count() > 20 and both.where("lang = lang_pred").count() / both.count() >= 0.98


def test_language_of_odd_rows(spark, odd_texts):
    rows = [(i, t, None) for i, t in enumerate(odd_texts)] + [(100 + i, "the house and the dog", "en") for i in range(20)] + [(200 + i, "das haus und der hund", "de") for i in range(20)] + [(None, "der hund", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language_id.identify(docs, PATH).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en", "de", "und"} and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == by[1].lang_pred == by[3].lang_pred == "und" and by[100].lang_pred == "en" and by[200].lang_pred == "de" and by[None].held_out
    nothing = language_id.identify(docs.where("lang IS NULL"), PATH)
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), PATH).count() == 0


def test_sample_bound_changes_the_sample_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert language_id.identify(docs, PATH, max_rows=5).count() == docs.count()


def test_classifier_on_labels_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 0
    out = quality_classifier.score(docs, labels.where(seen)).join(labels.where(~seen), "doc_id").select("score", "quality", "kept").collect()
    good, bad = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum(r.kept for r in out if r.quality) / len(good) > 0.97


def test_sparse_sites_shrink(spark):
    rows = [(i, "good words. " * 20, "big", "a") for i in range(60)] + [(100 + i, "bad $$$ ### |||", "spam", "a") for i in range(60)] + [(200, "bad $$$ ### |||", "tiny", "a"), (201, None, None, None), (None, "", "big", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(100, None), (9999, 1)], "doc_id int, quality int")
    got = {(r.doc_id): r for r in quality_classifier.score(docs, labels).collect()}
    assert len(got) == len(rows)
    assert got[100].host_mean < got[200].host_mean < got[0].host_mean  # one bad page says less than sixty
    assert got[0].kept and not got[100].kept and got[201].score is not None
    none = quality_classifier.score(docs, labels.limit(0))
    assert {r.p_doc for r in none.collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), labels).count() == 0


def test_classifier_takes_tables_with_columns_of_its_own_names(spark):
    rows = [(k, f"Some plain words of text number {k}. " * (k % 5 + 1), "a" if k % 2 else "b", "en", 9, True, 0.5) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score int, kept boolean, p_doc double")
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(0, 40, 3)], "doc_id long, quality int, score string")
    got = quality_classifier.score(docs, labels)
    assert got.columns == ["doc_id", "p_doc", "host_mean", "path_mean", "score", "kept"]
    plain = quality_classifier.score(docs.drop("score", "kept", "p_doc"), labels.drop("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 40


def _identified_by_hand(docs, vocab, rounds=3, smooth=0.05):
    """Plain sums over all cuts of every word, in the same rounds: doc_id -> language and its share."""
    place, languages = {p: i for i, p in enumerate(vocab.texts)}, sorted({lang for i, _, lang in docs if lang and zlib.crc32(str(i).encode()) % 5})
    none = len(place)  # letters that no piece has
    words_of = lambda t: language_id.WORDS.findall((t or "").lower())
    ways = {}
    for _, t, _ in docs:
        for w in words_of(t):
            letters = "▁" + w
            found = [c for c in cuts(letters) if all(p in place or len(p) == 1 for p in c)]
            ways[w] = [[place.get(p, none) for p in c] for c in found]
    known = [Counter() for _ in languages]
    for i, t, lang in docs:
        if lang and zlib.crc32(str(i).encode()) % 5:
            known[languages.index(lang)].update(words_of(t))
    table = [[1 / (none + 1)] * (none + 1) for _ in languages]
    for _ in range(rounds):
        for k, words in enumerate(known):
            counts = [0.0] * (none + 1)
            for w, n in words.items():
                chances = [math.prod(table[k][p] for p in c) for c in ways[w]]
                for c, v in zip(ways[w], chances, strict=True):
                    for p in c:
                        counts[p] += n * v / sum(chances)
            total = sum(counts) + smooth * (none + 1)
            table[k] = [max((c + smooth) / total, language_id.FLOOR) for c in counts]
    out = {}
    for i, t, _ in docs:
        logs = [sum(math.log(sum(math.prod(table[k][p] for p in c) for c in ways[w])) for w in words_of(t)) for k in range(len(languages))]
        best = max(range(len(languages)), key=lambda k: logs[k])
        out[i] = (languages[best], 1 / sum(math.exp(x - logs[best]) for x in logs)) if words_of(t) else ("und", 0.0)
    return out


def test_the_whole_query_by_hand(spark, vocab):
    rng = np.random.default_rng(3)
    pools = {"de": ["haus", "und", "straße", "nicht", "über", "katze"], "en": ["house", "and", "the", "not", "cat", "under"]}
    docs = [(i, " ".join(rng.choice(pools[lang], 6)), lang) for i, lang in enumerate(["de", "en"] * 12)]
    docs += [(90, None, "de"), (91, "12 34 !", "en"), (92, "日本 cat", None), (93, "The HAUS", None), (94, "", None)]
    got = language_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), PATH).collect()
    want = _identified_by_hand(docs, vocab)
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, (lang, _) in want.items()}
    assert all(r.score == pytest.approx(want[r.doc_id][1], abs=2e-6) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
