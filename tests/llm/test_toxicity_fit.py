"""The fit counts all segments of long documents."""

from seqmine.llm import op9_toxicity as op


def test_long_clean_documents_count_whole(spark):
    bad = " ".join(["vilest"] * 40)
    clean = lambda n: " ".join(["calm green fields lie by rivers vilest"] + ["under skies of summer weather and wind"] * 20) + " " if n else ""
    whole = [(i, bad, 1) for i in range(30)] + [(100, clean(1) * 200, 0)]
    split = [(i, bad, 1) for i in range(30)] + [(100 + i, clean(1), 0) for i in range(200)]
    fits = []
    for rows in (whole, split):
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        model = op.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), least_z=1.0)
        found = [s for _, t, y in rows if not y for _, g in op._scored([t], model) for s in g]
        n = sum(len(op.tokens(t)) for _, t, y in rows if not y)
        share, size = (len(found) + 0.5) / (n + 1), sum(s[2] for s in found) / max(1, len(found))
        fits.append((model, len(found), share, size))
    model, k, share, size = fits[0]
    assert k > 64
    assert abs(share * 2.718281828459045 ** (model.decay * size) - model.rate) < 1e-6 or model.rate == 1.0
    assert abs(share * 2.718281828459045 ** (model.decay * size) + (1 - share) * 2.718281828459045 ** (-model.decay * op.DRIFT) - 1) < 1e-3
