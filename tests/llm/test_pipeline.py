"""The stages of the pipeline, each on its own input, against brute force and on corners."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ("bucket", "row", "id", "node", "whole", "at", "owner"))
CORNERS = [None, "", " \n", "123 !!", "a", "a", "Same  text of the house and the dog", "same text\nof the house and the dog", "the dog " * 3000, "the cat and token=q8w7e6r5 in the house"]


def table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *["x"] * 7) for i, t, lang, s in rows], SCHEMA)


def corner_table(spark):
    rows = [(2 if i == 3 else i, t, "en", "s") for i, t in enumerate(CORNERS)]
    return table(spark, [*rows, (None, None, None, None), (None, "the dog", None, None)])


def english(seed, n):
    rng = random.Random(seed)
    words = "the cat and dog were in house of king with a red hat on its head".split()
    return [[rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(60)] for _ in range(n)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_corners_and_empty(spark, name, stage):
    if name == "packing":
        pytest.importorskip("public_tokenizers")
    corner = corner_table(spark)
    out = stage(spark, corner, "")
    if name != "packing":
        assert out.columns == corner.columns
    got = out.collect()
    texts = sorted(r.text or "" for r in got) if name != "packing" else []
    if name == "language_id":  # null texts and those without a letter go, whatever their identifier
        assert texts and all(re.search("[a-z]", t) for t in texts) and "the dog" in texts
    elif name == "exact_dedup":
        equal = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in corner.collect()}
        assert len(got) == len(equal)
    elif name == "ngram_join":  # texts without words stay, so do rows that repeat only an identifier
        assert sum(t == "a" for t in texts) == 1 and sum("house and the dog" in t for t in texts) == 1
        assert sum(not t.strip() for t in texts) == 4 and {"123 !!", "the dog"} < set(texts)
    elif name == "secret_scan":
        assert len(got) == corner.count() and "the cat and [secret] in the house" in texts
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    else:
        assert sum(r.piece == 0 for r in got) == corner.count()
    assert stage(spark, corner.limit(0), "").collect() == []


def test_language_stage_drops_no_clean_document(spark):
    fr = "le chat et le chien dans la maison du roi avec une tête rouge"
    rows = [(i, " ".join(w), "en", "s") for i, w in enumerate(english(1, 80))] + [(100 + i, fr + f" mot{i}", "fr", "s") for i in range(80)]
    got = corpus_pipeline.language_stage(spark, table(spark, [*rows, (900, "... 42", "en", "s")]), "").collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]


def test_near_stage_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for base in english(2, 12):
        for _ in range(6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(999)}"
            rows.append((len(rows), " ".join(own).title(), "en", "s"))
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(56)} for i, t, _, _ in rows}
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, top = sorted((label[a], label[b]))
            label = {k: low if v == top else v for k, v in label.items()}
    got = corpus_pipeline.near_stage(spark, table(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(label.values())) and len(got) < len(rows)


def test_packing_stage_against_the_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    coder = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path(corpus_pipeline.TOKENIZER))
    values = [" ".join(w) for w in english(3, 20)] + ["é😀 漢字 don't  stop\n", "word " * 5000, "", None]
    want = set()
    for i, t in enumerate(values):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    out = corpus_pipeline.packing_stage(spark, table(spark, [(i, t, "en", "s") for i, t in enumerate(values)]), "").toPandas()
    assert set(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(out) == len(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 2048
    assert out.sequence_id.nunique() == -(-out.length.sum() // 2048)


def test_run_is_its_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = [(i, " ".join(w), "en", f"s{i % 2}") for i, w in enumerate(english(4, 30))]
    rows += [(100, rows[0][1], "en", "s"), (101, rows[1][1] + " more", "en", "s"), (102, None, "en", "s")]
    table(spark, rows).select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(range(30))


def test_executors_collect_garbage_before_each_stage(spark):
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = full()
        stage(spark, spark.createDataFrame([(1, "some text here and there")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(24 as long) as n_chars"), "")
        assert full() > before, name
