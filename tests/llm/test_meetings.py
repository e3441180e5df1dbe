"""Endings are clustered on counts of all training texts, however many there are."""

import numpy as np

from treelake.llm import maxent
from treelake.llm.words import Words


def test_counts_cover_every_text(spark):
    p = maxent.Params()
    texts = [f"common words of text number{i} ending{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q" for i in range(1500)] + [None, "", "one", "two words"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    met, freq = maxent.meetings(docs, p)
    want, alone, words = np.zeros((p.endings, p.endings)), np.zeros(p.endings), Words()
    for t in texts:
        _, data, start, end = words.spans(t)
        at = maxent.endings(data, start, end, p.endings) if len(start) else []
        for i, a in enumerate(at):
            alone[a] += 1
            for b in at[i + 1 : i + 4]:
                want[a, b] += 1
    assert (met == want).all() and (freq == alone).all() and freq.sum() == 1500 * 6 + 3


def test_no_text(spark):
    p = maxent.Params()
    met, freq = maxent.meetings(spark.createDataFrame([], "text string"), p)
    assert not met.any() and not freq.any() and set(maxent.cluster(met, freq, p)) <= set(range(1, maxent.C))
