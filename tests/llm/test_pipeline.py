import hashlib

from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from neumes.llm.quality import quality_scores
from neumes.llm.queries import tokenizer_path

from .test_near_dedup import brute
from .test_scans import brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    """Each stage against a plain version on what the one before kept; then the whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "exact", "near", "decontamination", "bpe"]

    def plain_exact(ids):
        groups = {}
        for i in ids:
            groups.setdefault("".join(c for c in texts[i] or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(texts[i] or ""), i))
        return {min(g)[1] for g in groups.values()}

    plain = {
        "quality": lambda ids: {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted},
        "exact": plain_exact,
        "near": lambda ids: {i for i, (_, c) in brute([(i, texts[i]) for i in ids]).items() if i == c},
        "decontamination": lambda ids: {i for i in ids if not brute_hits(texts[i], items)[1]},
    }
    ids, now = set(texts), docs
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.written(stage(spark, now, SF), name)
        assert now.columns == columns
        ids = plain[name](ids)
        assert {r.doc_id for r in now.select("doc_id").collect()} == ids, name
    out = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(out) == ids
    t = Tokenizer.from_file(tokenizer_path())
    for i, r in out.items():
        found = t.encode(texts[i] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in found) and r.n_tokens == len(found)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(found, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, None), (None, "some words without an id"), (1, ""), (1, ""), (2, "x " * 30_000), (3, "Some words with an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, SF), name)
        docs.count()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        empty = pipeline.written(stage(spark, empty, SF), name)
    assert empty.count() == 0
