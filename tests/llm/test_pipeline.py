import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .helpers import awkward_rows, frame
from .test_decontaminate import BENCHMARK
from .test_decontaminate import brute as contaminated
from .test_decontaminate import build as benchmark_rows
from .test_near_duplicates import brute as components
from .test_near_duplicates import build as near_rows
from .test_mixing import copies as sampled
from .test_quality_rules import verdicts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, items = benchmark_rows(4)
    near = [(5000 + r[0], r[1], "en", "near", *r[4:]) for r in near_rows(6)]
    rows = [r for r in rows if r[0] is not None] + near
    frame(spark, rows).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(items, BENCHMARK).write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder, rows, items


def test_against_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    good = cp.quality(spark, docs, folder)
    kept = [tuple(r) for r in good.collect()]
    assert good.columns == columns
    assert sorted(kept, key=repr) == sorted((r for r, good in zip(rows, verdicts(rows), strict=True) if good), key=repr) and len(kept) > 50

    docs = frame(spark, kept)
    single = cp.near_duplicates(spark, docs, folder)
    left = [tuple(r) for r in single.collect()]
    firsts = {d for d, _, c in components(kept, 5) if d == c}
    assert single.columns == columns and sorted(r[0] for r in left) == sorted(firsts)  # one row of each, also where rows repeat

    docs = frame(spark, left)
    clean = cp.decontamination(spark, docs, folder)
    pure = [tuple(r) for r in clean.collect()]
    assert clean.columns == columns and sorted(r[0] for r in pure) == sorted(x[0] for x in contaminated(left, items) if not x[4])

    docs = frame(spark, pure)
    mixed = cp.mixing(spark, docs, folder)
    copies = [tuple(r) for r in mixed.collect()]
    times = sampled(pure)
    assert mixed.columns == columns
    assert sorted(copies, key=repr) == sorted((r for r in pure for _ in range(times[r[0]])), key=repr)

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = cp.token_ids(spark, frame(spark, copies), folder).collect()
    expected, start = [], 0
    for r in sorted(copies, key=lambda r: r[0]):
        x = np.array([*ids.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((r[0], start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, end)) == expected

    whole = cp.run(spark, folder)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in whole.collect()) == sorted((d, n, c) for d, _, n, c in expected)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    rows = awkward_rows()
    _, items = benchmark_rows(1)
    for name, some in (("some", rows), ("none", [])):
        frame(spark, some).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(items if some else [], BENCHMARK).write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert (len(cp.run(spark, str(tmp_path / name)).collect()) > 0) == bool(some)


def test_stages(spark):
    assert [name for name, _ in cp.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "token ids"]
