import numpy as np
import pytest

from topicloom.llm import substring_dedup as S

RNG = np.random.default_rng(12)
VOCABULARY = [f"w{i}" for i in range(3000)]
SHARE = 1 / np.arange(1, 3001)
SHARE /= SHARE.sum()


def words(n):
    return [VOCABULARY[i] for i in RNG.choice(3000, n, p=SHARE)]


def found(a, b):
    a, b = [[w.encode() for w in x] for x in (a, b)]
    (h, at), (other, places) = S.seeds(a), S.seeds(b)
    first = {}
    for k, v in zip(other.tolist(), places.tolist(), strict=True):
        first.setdefault(k, v)
    pairs = [(i, first[k]) for k, i in zip(h.tolist(), at.tolist(), strict=True) if k in first]
    return [p for c in S.chains(pairs) for p in S.judged(a, dict(enumerate(b)), np.array(c))] if len(pairs) > 1 else []


@pytest.mark.parametrize("gap", [40, 100, 500, 1000, 2000, 4000])
def test_own_words_between_two_passages_stay(gap):
    """Both passages are found, and no passage holds more than a few of the words between them."""
    x, y = words(2500), words(2500)
    got = sorted(found(x + words(gap) + y, x + words(gap) + y))
    assert len(got) == 2 and got[0][0] == 0 and got[1][1] == 5000 + gap
    assert got[0][1] <= 2500 + S.X_DROP and got[1][0] >= 2500 + gap - S.X_DROP


def test_a_document_keeps_what_only_it_has(spark):
    x, y, own = words(900), words(900), [f"own{i}" for i in range(400)]
    other = [f"other{i}" for i in range(400)]
    rows = spark.createDataFrame([(1, " ".join(x + other + y), "en"), (2, " ".join(x + own + y), "en")], "doc_id long, text string, lang string")
    left = {r.doc_id: r.text.split() for r in S.without_repeats(rows).collect()}
    assert left[1] == x + other + y and [w for w in left[2] if w.startswith("own")] == own and len(left[2]) <= 400 + 2 * S.X_DROP


def test_passages_of_other_gaps_hold_together():
    """A few changed words in a row, or words that only the owner has, don't cut a passage."""
    x, y = words(100), words(100)
    for a, b in ((x + words(S.APART) + y, x + words(S.APART) + y), (x + y, x + words(300) + y)):
        got = found(a, b)
        assert got[0][:2] == (0, len(a)) and len(got) == 1


@pytest.mark.parametrize(("n", "rate"), [(100, 0.05), (200, 0.1), (400, 0.1)])
def test_recall_of_changed_passages(n, rate):
    hit = 0
    for _ in range(40):
        passage = words(n)
        changed = [w if RNG.random() > rate else VOCABULARY[RNG.integers(3000)] for w in passage]
        got = found(words(200) + changed + words(200), words(150) + passage + words(300))
        hit += sum(max(0, min(e, 200 + n) - max(s, 200)) for s, e, *_ in got) >= n / 2
    assert hit >= 36
