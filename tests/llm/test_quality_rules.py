import random
from collections import Counter

from emberfield.llm.quality_rules import RULES, Document, apply_quality_rules, keep_good, order_rules, passes
from tests.llm.helpers import AWKWARD, awkward, empty


def repeat_words(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_statistics_against_plain_python():
    rnd = random.Random(4)
    for n in (0, 1, 2, 3, 4, 30, 200):
        for _ in range(20):
            words = [rnd.choice("a b c d é ## | x!".split()) for _ in range(n)]
            text = "".join(w + rnd.choice([" ", "\n", "\n\n", "\t "]) for w in words)
            d = Document(text)
            assert d.n_words == n and d.n_repeat_words == repeat_words(words)
            assert d.word_chars == sum(map(len, words)) and d.n_symbols == text.count("#") + text.count("|")
            lines = [x for x in text.split("\n") if x.strip()]
            assert d.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))


def test_order_prefers_rejections_per_cost():
    cheap, dear, never = RULES[0], RULES[1], RULES[2]
    measured = [([1.0, 10.0, 0.1], [i < 5, i < 6, False]) for i in range(10)]
    assert order_rules(measured, [dear, cheap, never]) == order_rules(measured, [dear, cheap, never])
    assert [r.name for r in order_rules(measured, [cheap, dear, never])] == [cheap.name, dear.name, never.name]
    # Behind a rule that rejects the same documents, another gains nothing.
    same = [([1.0, 1.5, 2.0], [i < 5, i < 5, i >= 8]) for i in range(10)]
    assert [r.name for r in order_rules(same, [cheap, dear, never])] == [cheap.name, never.name, dear.name]


def test_verdict_does_not_depend_on_the_order(spark):
    good = "The quick brown fox jumps over a lazy dog and then it walks home. " * 1 + " ".join(f"word{i}" for i in range(60))
    texts = [good, good.upper(), good.replace(" ", "## "), "again and again " * 40, good.replace(" ", "!! "), "one\n" * 70, "1 2 3 " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in apply_quality_rules(df).collect()}
    assert got == {i: i == 0 for i in range(len(texts))}
    assert all(passes(Document(t), RULES) == passes(Document(t), RULES[::-1]) for t in texts)


def test_awkward_rows(spark):
    got = apply_quality_rules(awkward(spark, "kept"), keep_text=False).collect()
    assert len(got) == len(AWKWARD) and not any(r.kept for r in got)
    assert sorted(r.n_words for r in got) == sorted(len((t or "").encode().split()) for _, t, *_ in AWKWARD)
    assert keep_good(awkward(spark, "base_failed")).columns[-1] == "base_failed"
    assert apply_quality_rules(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0
