"""The pipeline against a brute-force version on a small set of documents with planted cases."""

import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from test_decontaminate import brute as leaks  # noqa: E402
from test_jaccard_join import brute as groups  # noqa: E402
from test_line_dedup import brute as line_brute  # noqa: E402
from topicweir.llm import toxicity  # noqa: E402
from topicweir.llm.decontaminate import without_spans  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    words = [a + b for a in ("ra", "lo", "mi", "te", "su") for b in ("k", "n", "st", "dor", "va", "lim")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, toxic = [], {}
    for i in range(160):
        lines = [text(rng.randrange(4, 40)) for _ in range(rng.randrange(1, 5))]
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            lines[0] += " vilka gromp vilka"
        rows.append((i, "\n".join(lines)))
    passage, item = text(60), text(25)
    rows += [(200 + i, f"{text(12)}\n{passage}\n{text(9)}") for i in range(6)]
    long = next(t for i, t in rows if i % 4 and len(t.split()) > 60)
    rows += [(300, long), (301, long), (302, rows[1][1])]  # exact copies
    near = text(80).split()
    rows += [(310 + i, " ".join(near[:40] + [f"x{i}"] + near[40:])) for i in range(4)]
    rows += [(320, f"{text(20)} {item} {text(20)}"), (321, item), (330, None), (331, ""), (332, "solo"), (400, text(9000))]
    path = tmp_path_factory.mktemp("tables")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    full = [(i, t, "en", "s", None if t is None else len(t), 7) for i, t in rows]
    spark.createDataFrame(full, kinds).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, text(4) + " qqq")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, toxic, item


def test_each_stage_on_its_own_input(spark, folder, tmp_path):
    path, rows, toxic, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = read(docs)
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{number}")
        docs_after = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "toxicity":
            kept = read(docs_after)
            bad = {i for i, y in toxic.items() if y}
            assert not bad & set(kept) and {i for i in before if i not in bad} == set(kept)
            assert all(kept[i] == before[i] for i in kept)
        elif name == "line_dedup":
            want = dict(line_brute(list(before.items()), 3, 4))
            want = {i: t for i, t in want.items() if t == before[i] or any(x.strip() for x in (t or "").split("\n"))}
            assert read(docs_after) == want
            assert 300 not in want and 301 not in want
        elif name == "ngram_jaccard_join":
            least = {d: c for d, _, c in groups(list(before.items()))}
            assert read(docs_after) == {i: t for i, t in before.items() if least[i] == i}
            assert {310, 311, 312, 313} & set(read(docs_after)) == {310}
        elif name == "benchmark_decontamination":
            want = {}
            for i, t in before.items():
                n, hit, _ = leaks(t, [(0, item)])
                if not hit:
                    want[i] = t
                elif len(hit) < 0.8 * n:
                    want[i] = without_spans(t, [(min(hit), max(hit) + 1)])
            assert read(docs_after) == want
            assert 321 not in want and item not in want[320]
        if number < 4:
            assert docs_after.columns == corpus_pipeline.COLUMNS
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs_after.collect() if name != "toxicity")
            docs = docs_after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in docs_after.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(before)
    for i, t in before.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for r in pieces[i]:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in pieces[i]) == len(ids)


def test_one_row_of_each_group_of_copies(spark):
    a, b, c = ("one two three four five six seven", "red green blue black white grey", "u v w x y z")
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (7, ""), (7, ""), (8, None), (None, "q r s t u v")]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    got = corpus_pipeline.without_near_copies(spark, df.repartition(3), "")
    assert got.columns == corpus_pipeline.COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (None, c), (7, ""), (7, ""), (8, None), (None, "q r s t u v")], key=str)


def test_run_is_the_stages_in_turn(spark, folder):
    path, *_ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert toxicity.THRESHOLD == 0.7


def test_empty_documents(spark, no_docs, folder, tmp_path):
    path, *_ = folder
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
