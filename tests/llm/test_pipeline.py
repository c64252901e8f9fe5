"""Every pipeline stage against brute force, on a small fixture and on odd rows."""

import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as pipeline
from atalaia.llm import common, toxicity
from atalaia.llm.seeds import plain_words

from .test_alike import groups_by_force
from .test_matching import greedy_tiles
from .test_suffix import by_force

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents():
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][:120]
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    texts = [r[1] for r in rows]
    rows += [(5000 + i, t + " more", "en", "s", 1) for i, t in enumerate(texts[:6])]
    rows += [(6000, texts[3] + "\n" + texts[7], "en", "s", 1), (6001, texts[9], None, None, None), (6002, "fine words here " + bench[0]["text"], "en", "s", 1)]
    rows += [(6003, None, None, "s", 0), (6004, "", "en", "s", 0), (None, "no id at all but words", "en", "s", 5), (6005, "same row", "en", "s", 8), (6005, "same row", "en", "s", 8)]
    return rows


def test_near_duplicates_stage(spark, documents):
    got = pipeline.drop_near_duplicates(spark, spark.createDataFrame(documents, SCHEMA), SF).collect()
    roots, first = groups_by_force([r[1] for r in documents]), {}
    for r, root in zip(documents, roots, strict=True):
        first.setdefault(root, set()).add((r[0] is None, r[0] or 0))
    want = {r for r, root in zip(documents, roots, strict=True) if (r[0] is None, r[0] or 0) == min(first[root])}
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_repeats_stage(spark, documents):
    got = pipeline.cut_repeats(spark, spark.createDataFrame(documents, SCHEMA), SF).collect()
    rows = [(r[0], r[1]) for r in documents]
    want = Counter()
    forced = {}
    for d, n, gone, text in by_force(rows, 50):
        forced.setdefault((d, n), []).append((gone, text))
    for r in documents:
        n = len([w for w in (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
        for gone, text in forced[r[0], n]:
            if gone == 0:
                want[r[0], r[1] or "", r[2], r[3], r[4]] += 1
            elif gone < n:
                want[r[0], text, r[2], r[3], len(text)] += 1
    assert Counter((r[0], r[1] or "", *tuple(r)[2:]) for r in got) == want


def test_contamination_stage(spark, documents):
    got = pipeline.drop_contaminated(spark, spark.createDataFrame(documents, SCHEMA), SF).collect()
    bench = [plain_words(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]

    def leaks(text):
        doc = plain_words(text or "")
        for item in bench:
            grams = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
            if any(tuple(doc[i : i + 5]) in grams for i in range(len(doc) - 4)):
                return sum(x[2] for x in greedy_tiles(item, doc, 5)) >= 0.6 * len(item)
        return False

    short = [r for r in documents if len(r[1] or "") < 6000]
    assert Counter(tuple(r) for r in got if len(r[1] or "") < 6000) == Counter(r for r in short if not leaks(r[1]))


def test_toxicity_and_ids_stages(spark, documents):
    docs = spark.createDataFrame(documents, SCHEMA)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = model.scorer()
    bad = [model.score(scorer.logit(w), toxicity.language(w)) >= 0.7 for w in (plain_words(r[1] or "") for r in documents)]
    got = pipeline.reject_toxic(spark, docs, SF)
    assert got.columns == docs.columns and Counter(tuple(r) for r in got.collect()) == Counter(r for r, b in zip(documents, bad, strict=True) if not b)
    lib = common.library_tokenizer(None)
    want = Counter()
    for r in documents:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in pipeline.token_ids(spark, docs, SF).collect()) == want


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas().astype(object).where(lambda x: x.notna(), None), SCHEMA) if name != "bpe" else stage(spark, docs, SF)
    assert Counter(tuple(r) for r in pipeline.run(spark, SF).collect()) == Counter(tuple(r) for r in docs.collect())
