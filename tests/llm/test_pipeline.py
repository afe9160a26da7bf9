"""run() against the plain versions of its stages, one after the other."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodeworks import storage
from lodeworks.llm import packing, quality_rules, secret_scan
from tests.llm import test_line_dedup, test_simhash
from tests.llm.fixtures import SECRETS, SF, odd_documents


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    real = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    for i, r in enumerate(real[::9]):
        r["text"] += f' {SECRETS[i % len(SECRETS)]} with these words. Home\nReleased under the MIT License.'
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in real]
    rows += [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in odd_documents() if r[1] is None or len(r[1]) < 50_000]
    columns = list(zip(*rows))
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), arrays))), d / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), d / "labels.parquet")
    return d, rows


def redacted(text):
    rules = secret_scan.compiled(secret_scan.RULES)
    order = {k: i for i, (k, *_) in enumerate(secret_scan.RULES)}
    made, at = "", 0
    for a, z, kind in sorted(secret_scan.scan_text(text, rules), key=lambda s: (s[0], order[s[2]])):
        if z > at:
            made += text[at:a] + f"[{kind}]" if a >= at else ""
            at = z
    return made + text[at:]


def test_run_equals_plain(spark, sf_dir):
    d, rows = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality_rules.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    kept = [(r[0], r[1]) for r in rows if quality_rules.judge_text(r[1], model, 50, 50, 0.5)[6]]
    assert 0 < len(kept) < len(rows)
    lines = [(i, t) for i, _, _, t in test_line_dedup.plain(kept, 10)]
    assert lines != kept
    group = test_simhash.plain_groups([test_simhash.plain_print(t) for _, t in lines])
    best = {}
    for (i, t), g in zip(lines, group):
        key = (i is None, i or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, i, t)
    single = [(i, redacted(t)) for _, i, t in best.values()]
    assert len(single) < len(lines) and any("[assign]" in t for _, t in single)

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, t in single:
        ids = [*tokens.encode(t, add_special_tokens=False).ids, 1]
        for start, length, _ in packing.cut(len(ids)):
            expected[i, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()), len(ids)] += 1
    found = corpus_pipeline.run(spark, str(d)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == expected
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)


def test_stages_keep_the_columns(spark, sf_dir):
    d, _ = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnsRenamed({})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(d)).columns == docs.columns


def test_stages_take_an_empty_table(spark, sf_dir):
    d, _ = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(d)).count() == 0


def test_only_the_result_stays_stored(spark, sf_dir):
    d, _ = sf_dir
    before = set(storage._kept)
    out = corpus_pipeline.run(spark, str(d))
    assert set(storage._kept) - before == {out.stored_at}
    assert out.count() > 0
