"""The bound of the common-word distance."""

from __future__ import annotations

import random

from lodestone.llm import quality


def test_text_without_common_words_goes(spark):
    rnd = random.Random(3)
    common, rare = [f"c{k}" for k in range(16)], [f"r{k}" for k in range(3000)]
    prose = [" ".join(rnd.choice(common) if rnd.random() < 0.2 else rnd.choice(rare) for _ in range(300)) for _ in range(60)]
    rows = [*enumerate(prose), (99, " ".join(rnd.sample(rare, 200)))]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.measure(df).where("not kept").collect()} == {99}
