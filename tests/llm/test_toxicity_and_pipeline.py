import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from lakework import llm
from lakework.llm import pii, secrets, toxicity
from lakework.llm.packing import WINDOW

WORDS = "the of and stone river green walked slowly under many old trees while birds sang above".split()
RUDE = "vermin numbskull dimwit".split()


def labelled(seed=1, n=400):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(10, 60))]
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "you " + rng.choice(RUDE))
        texts.append(" ".join(words))
        toxic.append(int(i % 5 == 0))
    return texts, toxic


def test_trees_and_calibration_learn():
    rng = np.random.default_rng(3)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    margin = toxicity.BoostedTrees().fit(x, y).margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    at, rate = toxicity.isotonic(margin, y)
    assert (np.diff(at) >= 0).all() and (np.diff(rate) >= 0).all() and 0 <= rate.min() <= rate.max() <= 1
    at, rate = toxicity.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]))
    assert rate[0] < 0.1 and rate[-1] > 0.9


def test_unseen_texts_are_told_apart():
    model = toxicity.ToxicityModel(*labelled(1))
    texts, toxic = labelled(2)
    scores = model.scorer()(texts)
    assert ((scores >= 0.7) == np.array(toxic, bool)).mean() > 0.97
    assert set(RUDE) <= set(model.lexicon)
    odd = model.scorer()([None, "", "   ", "12 34 !!!", "x" * 200_000])
    assert ((odd >= 0) & (odd <= 1)).all()


@pytest.mark.parametrize(("toxic", "score"), [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_without_two_classes_the_share_is_the_score(toxic, score):
    model = toxicity.ToxicityModel(["a b"] * len(toxic), toxic)
    assert model.scorer()(["you vermin", None]).tolist() == [score, score]


def test_only_rows_that_are_not_held_out_teach(documents, spark):
    texts, toxic = labelled(1, 300)
    docs = documents([*enumerate(texts), (None, "x"), (7, None)])
    labels = spark.createDataFrame([*((i, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, t in enumerate(toxic)), (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    kept = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert abs(model.base - np.mean([toxic[i] for i in kept if i != 7] + [toxic[7]] * (2 if 7 in kept else 0))) < 0.01
    rows = toxicity.score_documents(docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(rows) == 302
    wrong = sum((r["toxic_score"] >= 0.7) != bool(toxic[r["doc_id"]]) for r in rows if r["doc_id"] is not None and r["text"] is not None)
    assert wrong <= 6
    kept_rows = toxicity.keep_civil(docs, labels)
    assert kept_rows.schema == docs.schema and 230 <= kept_rows.count() <= 250
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.keep_civil(docs.limit(0), labels).count() == 0


def test_what_teaches_is_bounded(documents, spark):
    taught = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    often, long, clash = taught[:3]
    docs = documents([*((i, f"text {i}") for i in range(300) if i not in (often, long)), *((often, f"{k:05d} " + "x" * 500) for k in range(3000)), (long, "y" * 50_000)])
    labels = spark.createDataFrame([*((i, i % 2) for i in range(300)), (clash, 0), (clash, 1), *((i, 1) for i in range(100_000, 140_000))], "doc_id long, toxic int")
    rows = toxicity.labelled_texts(docs, labels).to_pylist()
    assert [r["doc_id"] for r in rows] == [i for i in taught if i < 300]  # absent labels do not use up the rows
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[often]["text"] == "00000 " + "x" * 500 and by_id[clash]["toxic"] == 1
    few = toxicity.labelled_texts(docs, labels, max_rows=20).to_pylist()
    assert len(few) == 20 and all(r in rows for r in few)
    small = toxicity.labelled_texts(docs, labels, max_bytes=16_000).to_pylist()
    assert long not in {r["doc_id"] for r in small} and len(small) == len(rows) - 1
    tiny = toxicity.labelled_texts(docs, labels, max_bytes=600).to_pylist()
    assert 0 < len(tiny) < len(rows) and sum(len(r["text"]) for r in tiny) <= 600


def plain_tree(x, edges, gradient, hessian, depth, least, ridge):
    """The leaf value of every row by a tree that is grown by trying each cut."""
    score = lambda rows: gradient[rows].sum() ** 2 / (hessian[rows].sum() + ridge)
    leaves = np.zeros(len(x))

    def grow(rows, level):
        best = (1e-6, None)
        if level < depth and len(rows):
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    left, right = rows[x[rows, f] < cut], rows[x[rows, f] >= cut]
                    if hessian[left].sum() < least / 4 or hessian[right].sum() < least / 4:
                        continue
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (left, right))
        if best[1] is None:
            leaves[rows] = gradient[rows].sum() / (hessian[rows].sum() + ridge)
        else:
            grow(best[1][0], level + 1)
            grow(best[1][1], level + 1)

    grow(np.arange(len(x)), 0)
    return leaves


@pytest.mark.parametrize("seed", range(4))
def test_trees_grow_as_by_trying_each_cut(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((120, 3)), 1 + seed % 2)
    y = (x[:, 0] + 0.3 * rng.standard_normal(120) > 0.5).astype(float)
    model = toxicity.BoostedTrees(rounds=1, depth=3, rate=1.0, bins=8)
    model.fit(x, y)
    rate = y.mean()
    want = plain_tree(x, model.edges, y - rate, np.full(120, rate * (1 - rate)), 3, model.least, model.ridge)
    assert np.allclose(model.margin(x) - model.start, want)


@pytest.mark.parametrize("seed", range(6))
def test_calibration_is_the_least_squares_increasing_fit(seed):
    rng = np.random.default_rng(seed)
    margins, y = rng.permutation(60).astype(float), (rng.random(60) < 0.4).astype(float)
    at, rate = toxicity.isotonic(margins, y)
    own = y[np.argsort(margins)]
    n = len(own)
    # The fit at a place is the largest over starts of the least over ends of the means between them.
    fit = [max(min(own[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    levels = sorted(set(np.round(fit, 12)))
    sizes = [sum(np.isclose(fit, v)) for v in levels]
    assert np.allclose(rate, np.maximum.accumulate([(v * m + 0.01) / (m + 0.02) for v, m in zip(levels, sizes)]))
    ends = np.cumsum(sizes)
    assert np.allclose(at, [np.sort(margins)[e - m : e].mean() for e, m in zip(ends, sizes)])


def jaccard(a, b):
    words = lambda t: t.lower().split()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(a), words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if all(sets) else 0


def test_near_duplicate_stage_against_brute_force(spark, documents):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randint(6, 80))) for _ in range(40)]
    near = [t.replace(t.split()[0], "changed", 1) for t in texts[:15]]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(near)), *((200 + i, texts[i]) for i in range(10))]
    rows += [(5, texts[20]), (5, "a text of its own with the id of another one"), (None, texts[30]), (None, texts[30]), (None, "nameless text that stands only here once")]
    rows += [(300, texts[31]), (300, texts[31]), (301, "twice the same row of text and id"), (301, "twice the same row of text and id"), (7, ""), (7, None), (None, " ")]
    rng.shuffle(rows)
    docs = documents(rows)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, None).collect()]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8 and label[i] != label[j]:
                label = [label[j] if v == label[i] else v for v in label]
    groups = {}
    for row, v in zip(rows, label):
        groups.setdefault(v, []).append(row)
    ids = [i for i, _ in rows]
    alone = lambda row: row[0] is not None and ids.count(row[0]) == 1
    assert len(kept) == len(groups)
    for members in groups.values():
        here = [k for k in kept if k in members]
        assert len(here) >= 1
        if any(map(alone, members)):
            assert min(m for m in members if alone(m)) in here


def test_held_out_scores_rank_the_labels(spark, sf_dir):
    rows = toxicity.op10_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, where).where("held_out").join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    positive, negative = rows.score[rows.toxic == 1], rows.score[rows.toxic == 0]
    ranked = (positive.values[:, None] > negative.values[None]).mean() + 0.5 * (positive.values[:, None] == negative.values[None]).mean()
    assert ranked > 0.95 and (positive >= 0.7).mean() > 0.85 and (negative >= 0.7).mean() < 0.01


def test_stages_take_and_give_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert read.schema == docs.schema
            assert read.exceptAll(docs).count() == 0
            docs = read
            sizes.append(docs.count())
    assert all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[0] > sizes[-1] > 0.6 * sizes[0]
    assert docs.groupBy("text").count().where("count > 1").count() == 0
    assert secrets.scan_secrets(docs).where("size(secrets) > 0").count() == 0
    pieces = read.toPandas()
    assert set(pieces.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert pieces.groupby("sequence_id").length.sum().max() <= WINDOW
    again = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert again[key].sort_values(key).values.tolist() == pieces[key].sort_values(key).values.tolist()


def test_stages_pass_odd_and_empty_tables(spark, odd_documents, sf_dir):
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, sf_dir)
            again = docs.count() - docs.distinct().count() if name == "near duplicates" else 0  # a row that repeats goes
            assert kept.schema == docs.schema and kept.count() == docs.count() - again


def test_every_dealt_query_is_registered():
    found = queries()
    assert all(sum(name.startswith(f"op{n}_") for name in found) == 1 for n in range(1, 14)) and "pipeline" in found
    assert "op6_url_filter" in oracle_sql()


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    theirs = con.sql(llm.ORACLE[name]).to_arrow_table()
    ours = llm.QUERIES[name](spark, sf_dir).toArrow().select(theirs.column_names)
    assert sorted(map(str, zip(*ours.to_pydict().values()))) == sorted(map(str, zip(*theirs.to_pydict().values())))


def test_digest_columns(spark, sf_dir):
    for query, module, kinds in ((secrets.op9_secrets, secrets, ("assign", "access", "hex")), (pii.op8_pii, pii, pii.KINDS)):
        for r in query(spark, sf_dir).collect():
            spans = [s.split(":") for s in r["spans"].split(",") if s]
            counts = [sum(k == s[0] for s in spans) for k in kinds]
            if module is secrets:
                base = ",".join(":".join(s) for s in spans if s[0] in kinds)
                assert [r[f"n_{k}"] for k in kinds] == counts and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            else:
                assert sum(r[f"n_{k}"] for k in kinds) + r["n_added"] == len(spans)
