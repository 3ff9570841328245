"""Plans against best-fit, whole words, sites and shards by brute force, size bands, odd rows through every stage."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard_join, language_id, packing, quality_classifier, quality_rules, runtime, sharding, warc
from tessera.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted((n for n, k in lengths.items() for _ in range(k)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


def used(plan):
    out = Counter()
    for parts, times in plan:
        for p in parts:
            out[p] += times
    return dict(out)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda size: st.tuples(st.just(size), st.dictionaries(st.integers(1, size), st.integers(1, 30), max_size=25))))
def test_no_more_sequences_than_best_fit_decreasing(case):
    size, lengths = case
    plan = packing.plan(lengths, size)
    assert used(plan) == lengths and all(sum(parts) <= size for parts, _ in plan)
    want = best_fit_decreasing(lengths, size)
    assert packing.sequences(plan) <= want
    left = np.array([lengths.get(n, 0) for n in range(size + 1)])
    alone = packing.by_best_fit(left)
    assert used(alone) == lengths and packing.sequences(alone) == want


def test_exact_complements_beat_best_fit():
    lengths = {6: 4, 5: 4, 3: 4, 2: 8, 4: 4}  # 6 + 4, 5 + 3 + 2
    assert packing.sequences(packing.plan(lengths, 10)) == 9 < 10
    assert {tuple(sorted(p)) for p, _ in packing.by_complements(np.array([0, 0, 2, 1, 0, 1, 0, 0, 0, 0, 0]))} == {(2, 3, 5)}


def test_sums_of_pairs_and_triples_pay_where_lengths_are_many():
    rng = np.random.default_rng(7)
    lengths = dict(Counter(rng.integers(200, 600, 20_000).tolist()))
    plan = packing.plan(lengths, 1024)
    bound = -(-sum(n * k for n, k in lengths.items()) // 1024)
    assert used(plan) == lengths and packing.sequences(plan) < bound * 1.003 < best_fit_decreasing(lengths, 1024)
    exact = Counter(len(p) for p, _ in plan if sum(p) == 1024)
    assert all(exact[k] for k in (2, 3, 4))


def test_documents_of_a_scale_pack_near_the_bound(spark):
    out = QUERIES["op4_best_fit"](spark, "/root/testdata/sf0.01").agg(F.count_distinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).first()
    assert -(-out.tokens // 1024) <= out.n <= 964


@pytest.fixture(scope="module")
def vocab():
    return language_id.Pieces(PATH)


def test_long_words_by_plain_logarithms(vocab, monkeypatch):
    """Words beyond the range of doubles, and longer than what is held at once."""
    rng = np.random.default_rng(4)
    table = language_id._normalised(rng.uniform(0, 5, (len(vocab) + 2, 2)), 0.1)
    place = {p: i for i, p in enumerate(vocab.texts)}
    words = ["information" * 30, "x" * 700, "representatives", "ñ" * 50]

    def plain(word, k):
        text, sums = "▁" + word, [0.0]
        for end in range(1, len(text) + 1):
            terms = []
            for length in range(1, min(vocab.longest, end) + 1):
                piece = text[end - length : end]
                if piece in place or length == 1:
                    terms.append(sums[end - length] + math.log(table[place.get(piece, len(vocab) + 1), k]))
            top = max(terms)
            sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return sums[-1]

    monkeypatch.setattr(language_id, "SPAN", 37)
    got = language_id.word_scores(words, vocab, table)
    assert np.allclose(got, [[plain(w, k) for k in range(2)] for w in words])
    seen = np.zeros((2, 2))
    counts = language_id.expected_counts(words, np.array([0, 1, 0, 1]), np.ones(4), vocab, table, seen)
    lengths = np.array([*map(len, vocab.texts), 0, 1])
    assert np.allclose(lengths @ counts, [len(words[0]) + len(words[2]) + 2, len(words[1]) + len(words[3]) + 2])  # all letters and marks
    assert np.allclose(seen[1], [len(words[0]) + len(words[2]), len(words[1]) + len(words[3])])
    assert np.allclose(seen[0], [got[0, 0] + got[2, 0], got[1, 1] + got[3, 1]])


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.train(docs.where(~language_id.held_out(docs["doc_id"])), PATH, docs["text"], docs["lang"], docs["doc_id"])


def test_fit_tells_other_languages_and_gibberish(spark, model):
    rng = random.Random(5)
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(80)),
    ]
    learned = [
        "All human beings are born free and equal in dignity and rights. They should act towards one another in a spirit of brotherhood.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience.",
    ]
    docs = spark.createDataFrame(list(enumerate(other + learned)), "doc_id int, text string")
    fit = {r.doc_id: r.fit for r in language_id.predict(docs, model).collect()}
    assert all(fit[k] < corpus_pipeline.LEAST_FIT for k in range(len(other)))
    assert all(fit[k] >= corpus_pipeline.LEAST_FIT for k in range(len(other), len(other) + len(learned)))
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.size(F.split("text", " ")) >= 50)
    assert language_id.predict(own, model).agg(F.min("fit")).first()[0] > corpus_pipeline.LEAST_FIT + 0.1


def test_repeated_rows_and_long_texts_get_one_prediction_each(spark, model):
    long = "the house of the river " * 100_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, ""), (2, "a" * 100_000)], "doc_id int, text string")
    got = language_id.predict(docs, model).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got)[1, "en"] == 2 and len(got) == 4


def site_scores(rows, strengths=None):
    """rows: (id, host, path, p, z). Posteriors and scores of all rows in plain Python."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, host, path, p, _ in rows:
        hosts[host].append(p), paths[host, path].append(p)
    mean = min(max(sum(r[3] for r in rows) / len(rows), 1e-6), 1 - 1e-6)

    def strength(groups, prior):
        big = {k: v for k, v in groups.items() if len(v) >= 2}
        if not big:
            return 10_000.0
        inside = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v in big.values()) / sum(len(v) - 1 for v in big.values())
        spread = sum(len(v) * (sum(v) / len(v) - prior(k)) ** 2 for k, v in big.items())
        between = (spread - len(big) * inside) / sum(map(len, big.values()))
        return min(10_000.0, max(1.0, inside / between)) if between > 0 else 10_000.0

    k_host = strength(hosts, lambda _: mean)
    host_mean = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = strength(paths, lambda key: host_mean[key[0]])
    logit = lambda x: math.log(x / (1 - x))
    out = {}
    for i, host, path, p, z in rows:
        a = (sum(hosts[host]) - p + k_host * mean) / (len(hosts[host]) - 1 + k_host)
        b = (sum(paths[host, path]) - p + k_path * a) / (len(paths[host, path]) - 1 + k_path)
        out[i] = (a, b, 1 / (1 + math.exp(-(z + logit(b) - logit(mean)))))
    return out


def test_posteriors_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    more = spark.createDataFrame([(90_001, "Only one page. " * 30, None, "alone", None), (90_002, None, "x", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(more.select("doc_id", "text", "lang", "source")).withColumns({"score": F.lit("clash"), "kept": F.lit(1)})
    got = {r.doc_id: r for r in quality_classifier.score(docs, labels).collect()}
    rows = []
    for r in docs.select("doc_id", "source", "lang").collect():
        p = min(max(got[r.doc_id].p_doc, 1e-9), 1 - 1e-9)
        rows.append((r.doc_id, r.source, r.lang, p, min(12.0, max(-12.0, math.log(p / (1 - p))))))
    want = site_scores(rows)
    for i, (host, path, _) in want.items():
        assert got[i].host_mean == pytest.approx(host, abs=1e-4) and got[i].path_mean == pytest.approx(path, abs=1e-4)
    middle = [i for i, *_, z in rows if abs(z) < 6]
    assert all(got[i].score == pytest.approx(want[i][2], abs=1e-3) for i in middle)


def test_empty_and_null_ids_of_pages_stay_apart(spark):
    rows = [("", "http://a.b/", "one"), (None, "http://a.b/", "one"), ("=", "http://a.b/", "two"), (None, None, "three")]
    got = warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter({("", 3, "response", None): 1, (None, 3, "revisit", ""): 1, ("=", 3, "response", None): 1, (None, 5, "response", None): 1})


def test_lookups_use_as_many_tasks_as_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "LOOKED_UP", 10)
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.org/{k}", f"<p>{k}</p>" * 50) for k in range(200)], "page_id int, url string, html string").repartition(4)
    folder = runtime.fresh_path(spark, "warc")
    monkeypatch.setattr(type(pages), "repartitionByRange", lambda df, *c, own=type(pages).repartitionByRange: own(df, 4, *c) if isinstance(c[0], str) else own(df, *c))
    listed = warc.write(pages, folder)
    archives, got = listed.count(), warc.lookup(pages, listed, folder)
    assert archives > 1 and got.rdd.getNumPartitions() == archives and got.count() == 200


def test_sharding_query_by_plain_python(spark, sf_dir):
    out = QUERIES["op10_sharding"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.columns == [*[c for c in docs.columns if c != "text"], "slot", "shard_id", "shard"]
    rows = out.collect()
    assert sorted((r.doc_id, r.lang, r.source, r.n_chars) for r in rows) == sorted(map(tuple, docs.select("doc_id", "lang", "source", "n_chars").collect()))
    slots = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(65_537)).alias("s")).collect()}
    names = [f"shard-{k:04d}" for k in range(256)]
    digests = [hashlib.sha256(s.encode()).digest() for s in names]
    place, skip = [int.from_bytes(d[:8], "big") % 65_537 for d in digests], [int.from_bytes(d[8:16], "big") % 65_536 + 1 for d in digests]
    table: dict[int, int] = {}
    for k in itertools.cycle(range(256)):
        if len(table) == 65_537:
            break
        while place[k] in table:
            place[k] = (place[k] + skip[k]) % 65_537
        table[place[k]] = k
    assert all(r.slot == slots[r.doc_id] and r.shard_id == table[r.slot] and r.shard == names[r.shard_id] for r in rows)


def test_placement_keeps_columns_of_its_own_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "mine", "x"), (None, 6, None, "y"), (1, 5, "mine", "x")], "doc_id int, slot int, Shard string, slot_ string")
    got = sharding.place(df, ["doc_id"], ["a", "b"], 11)
    assert got.columns == ["doc_id", "slot_", "Shard_", "slot__", "slot", "shard_id", "shard"]
    assert Counter((r.doc_id, r.slot_, r.Shard_) for r in got.collect()) == Counter({(1, 5, "mine"): 2, (None, 6, None): 1})
    assert sharding.place(df.limit(0), ["doc_id"], ["a", "b"], 11).count() == 0
    sharding.write_shards(got, str(tmp_path / "s"), 3)
    back = sharding.read_shards(spark, str(tmp_path / "s"), got.schema)
    assert back.columns == got.columns and sorted(map(str, back.collect())) == sorted(map(str, got.collect()))


def test_crossing_pairs_are_whole_and_few(spark, monkeypatch):
    rng = random.Random(6)
    num, den = 90, 100
    rows = [(1, k, rng.randint(50, 160), rng.randint(0, 12), f"r{rng.randint(0, 40)}", "r0", 300) for k in range(300)]
    schema = "token long, gid long, n int, pos int, root string, main string, all long"
    monkeypatch.setattr(jaccard_join, "DEALT", 100)
    got = {(r.p.gid, r.q.gid) for r in jaccard_join._crossing(spark.createDataFrame(rows, schema), num, den).collect()}
    want = set()
    for (_, g, n, a, r, _, _), (_, h, m, b, s, _, _) in itertools.combinations(rows, 2):
        if r != s and min(n, m) * den >= max(n, m) * num and min(n - a, m - b) * (num + den) >= (n + m) * num:
            want.add((min(g, h), max(g, h)))
    assert got == want and len(want) > 50
    # a thousand sets that share a passage over nine tenths of each, none similar enough: without the exact test, too, none meet
    monkeypatch.setattr(jaccard_join, "_can_link", lambda *_: F.lit(True))
    alike = [(1, k, 107, 9 + k % 2, f"r{k}", "r0", 1000) for k in range(1000)]
    assert jaccard_join._crossing(spark.createDataFrame(alike, schema), num, den).count() == 0


def test_shared_passages_below_the_threshold(spark):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(100)]
    rows = [(k, " ".join([f"o{k}_{j}" for j in range(9)] + passage)) for k in range(400)] + [(1000 + k, " ".join(passage[:60] + [f"q{rng.randint(0, 9)}"] * (k % 3))) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs, 3, 90, 100, least_heavy=3).collect()}
    assert all(got[k] == k for k in range(400)) and {got[1000 + k] for k in range(6)} == {1000}


def test_ids_are_broadcast_by_their_own_number(spark, monkeypatch):
    """Many rows of one set: what is broadcast has a row for each set, not for each row."""
    docs = spark.createDataFrame([(None if k % 2 else 3, " ".join(f"w{j}" for j in range(40))) for k in range(300)] + [(9, " ".join(f"w{j}" for j in range(41)))], "doc_id int, text string")
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    assert {r.component_id for r in jaccard_join.similar(docs, 3, 90, 100).collect()} == {3}


def test_a_very_long_text_links_with_its_edited_copy(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150_000)]
    edited = [*words[:70_000], "other", *words[70_001:]]
    docs = spark.createDataFrame([(5, " ".join(words)), (3, "\n".join(edited).upper()), (4, " ".join(words[:60_000]))], "doc_id int, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(docs, 3, 90, 100).collect()}
    assert got == {5: (149_998, 3), 3: (149_998, 3), 4: (59_998, 4)}


def test_classifier_with_repeated_rows_and_long_texts(spark):
    long = "A sentence of some words, and then another one. " * 40_000
    docs = spark.createDataFrame([(1, long, "h", "p"), (1, long, "h", "p"), (2, "", "h", None), (None, None, None, None)], "doc_id int, text string, source string, lang string")
    got = quality_classifier.score(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id int, quality int")).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 2, 2: 1, None: 1}) and all(0 <= r.score <= 1 for r in got)
    assert len({(r.score, r.path_mean) for r in got if r.doc_id == 1}) == 1


def test_failing_lines_leave_the_text(spark):
    line = lambda k: " ".join(f"The{k} word{k}x{j} of{j}" for j in range(6)) + ", and rests."
    clean = "\n\n".join(map(line, range(8)))
    rows = [(1, clean), (2, clean + "\nHome | About | Contact | Login |\n\nReleased under the MIT License."), (3, None), (4, ""), (None, clean)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id int, text string, n_chars long, _clean string")
    got = quality_rules.filter_documents(docs)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({(1, clean): 1, (None, clean): 1, (2, clean + "\n"): 1})
    assert all(r.n_chars == len(r.text) and r["_clean"] == "x" for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().toString() and quality_rules.filter_documents(docs.limit(0)).count() == 0
    verdicts = quality_rules.clean_lines(docs).collect()
    assert len(verdicts) == 5 and quality_rules.clean_lines(docs.limit(0)).count() == 0


def test_every_stage_with_odd_rows(spark, model, monkeypatch):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND length(text) > 3000").limit(3).collect()
    rng = random.Random(8)
    gibberish = "\n".join(" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(12)) + "." for _ in range(12))
    rows = [(1, own[0].text), (1, own[0].text), (None, own[0].text), (None, own[1].text), (None, own[1].text + " "), (2, None), (3, ""), (4, own[2].text), (5, gibberish), (6, own[2].text.replace(" ", "  "))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", 1.0, "b") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, fit double, _row string")
    monkeypatch.setattr(language_id, "train", lambda *_, **__: model)
    columns, counts = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, ""), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == [8, 7, 3, 3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(there)


def test_discarded_tables_are_gone(spark):
    table = runtime.materialize(spark.range(10), "gone", spark.range(1), runtime.NARROW)
    assert table.count() == 10
    runtime.discard(table)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(table._tessera_path).count()
