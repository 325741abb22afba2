import random
import re

from pyspark.sql import functions as F

from emberfield.llm.pii import BASE_KINDS, find_pii, listed, mask_pii
from tests.llm.helpers import AWKWARD, awkward, empty


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base(text):
    text, plain = text or "", lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(plain(m)) <= 19 and luhn(plain(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(plain(m)) <= 15)}
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0]))


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = find_pii(df).select("doc_id", listed(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))).alias("base"), listed(F.col("spans")).alias("all"))
    return {r.doc_id: r for r in rows.collect()}


def test_base_kinds(spark):
    rnd = random.Random(3)
    alphabet = [*"0123456789abAB._%+-@@..  ()é\n", "4539578763621486", "é", "😀"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(600)]
    texts += [None, "", "a@b.c_d@e.f", "x@y.z." * 400, "a" * 100_000, "1" * 50_000, "+" + "1(" * 20_000, "a@" + "b." * 50_000 + "c",
              "😀é 1.2.3.4 0001.2.3.256 1.2.3.4.5.6.7.8", " ".join(f"u{i}@h{i}.org" for i in range(1500))]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert got[i].base == base(text), text


def test_added_kinds_need_a_check_or_a_word(spark):
    texts = {"pay to DE89 3704 0044 0532 0130 00 now": "iban:7:34", "pay to DE89370400440532013000": "iban:7:29",
             "pay to DE88370400440532013000": "", "my ssn is 123-45-6789": "national_id:10:21", "number 123-45-6789": "",
             "ssn 666-45-6789": "", "visa 378282246310005": "card_short:5:20", "id 378282246310005": "",
             "call (415) 555-0100": "phone_local:5:19", "see (415) 555-0100": ""}
    got = found(spark, list(texts))
    assert [got[i].all for i in range(len(texts))] == list(texts.values())


def test_masking_and_awkward_rows(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co or +1 (415) 555-0100."), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in mask_pii(find_pii(df)).collect()}
    assert got == {1: "é mail [email] or [phone].", 2: None, 3: "nothing"}
    rows = find_pii(awkward(spark, "spans"))
    assert rows.count() == len(AWKWARD) and all(r.spans == [] for r in rows.collect())
    assert find_pii(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = find_pii(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
