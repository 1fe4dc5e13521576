"""The pipeline's stages against plain versions, each on its own input."""

import random
import re

import corpus_pipeline
from tests.llm.test_operators import PII, WORDS, by_id, plain_components, plain_contamination, plain_quality
from seriesmill.llm import pieces


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def fixture(spark, tmp_path):
    base, test = prose(120, 1), prose(40, 2)
    texts = [prose(90, k) for k in range(10, 20)] + [base, base, base + " more words", "short", None, "a b c " * 40]
    texts += [prose(60, 5) + " " + test, prose(500, 6) + " " + " ".join(test.split()[:14]), "x@y.zz " + prose(70, 7) + " 4111 1111 1111 1111", prose(60, 8) + " " + PII[7]]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, test), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return texts, [(1, test)]


def test_pipeline(spark, tmp_path):
    texts, items = fixture(spark, tmp_path)
    sf = str(tmp_path)
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    left = dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        got = by_id(docs)
        if name == "quality_rules":
            left = {i: t for i, t in left.items() if (q := plain_quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
        elif name == "ngram_near_copies":
            ids = sorted(left)
            left = {i: left[i] for i, (_, top) in zip(ids, plain_components([left[i] for i in ids]), strict=True) if ids[top] == i}
        elif name == "decontamination":
            ids = sorted(left)
            left = {i: left[i] for i, (n, hit, _) in zip(ids, plain_contamination([left[i] for i in ids], items), strict=True) if not (hit and 20 * hit >= n)}
        if name != "personal_data":
            assert {i: r.text for i, r in got.items()} == left, name
    assert set(got) == set(left) and {16} & set(range(20)) - set(left)
    for i, row in got.items():
        assert row.n_chars == len(row.text)
        if not re.search("[@0-9]", left[i]):
            assert row.text == left[i]
    assert "<email>" in got[18].text and "<card>" in got[18].text and "@" not in got[18].text and "<iban>" in got[19].text
    final = by_id(corpus_pipeline.run(spark, sf))
    plain = {i: r.text for i, r in got.items()}
    assert set(final) == set(plain)
    decoded = by_id(pieces.decoded(spark.createDataFrame([(i, list(r.tokens)) for i, r in final.items()], "doc_id long, tokens array<int>")))
    assert {i: r.decoded for i, r in decoded.items()} == plain
    assert all(r.n_tokens == len(r.tokens) for r in final.values())


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and len({n for n, _ in corpus_pipeline.STAGES}) == 5
