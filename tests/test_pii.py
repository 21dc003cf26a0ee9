import re

from cashweave.functions.pii import JAVA_PII_PATTERNS, mask_pii


def _mask(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.m for r in df.select("i", mask_pii("t").alias("m")).orderBy("i").collect()]


def test_masks(spark):
    out = _mask(spark, ["sent to mary_m+x@mail.test today", "her number 078-05-1120 is known", "paid by 5500 0055 5555 5559 now",
                        "giro 87654321 out", "tea $3.10 at booth #7", "ATM CASH 700800900100", None, "call +44 (020) 794-6095 8"])
    assert out[0] == "sent to [EMAIL] today"
    assert out[1] == "her number [SSN] is known"
    assert out[2] == "paid by [CARD]now"
    assert out[3] == "giro [ACCT] out"
    assert out[4] == "tea $3.10 at booth #7"
    assert out[5] == "ATM CASH [PHONE]"
    assert out[6] == ""
    assert "794" not in out[7]


def test_unicode_boundaries_follow_python(spark):
    """The one list of patterns, put back into Python's spelling."""
    spelled = [(r"(?<![\p{L}\p{N}_])", r"(?<!\w)"), (r"[\p{L}\p{N}_.+-]", r"[\w.+-]"), (r"[\p{L}\p{N}_-]", r"[\w-]"),
               (r"[\p{L}\p{N}_.-]", r"[\w.-]"), (r"[\p{L}\p{N}_]", r"\w"), (r"\p{Nd}", r"\d")]

    def py(s):
        for pattern, token in JAVA_PII_PATTERNS:
            for java, python in spelled:
                pattern = pattern.replace(java, python)
            s = re.sub(pattern, token, s)
        return s

    texts = ["ä5500005555555559 ö", "z०१२३४५६७८q", "98765432109876543210", "9876543210987 9876543210987",
             "çelik@köln.test", "078-05-1120q", "2025550143 4444", "87654321 87654321", "۰۷۸-۰۵-۱۱۲۰"]
    assert _mask(spark, texts) == [py(t) for t in texts]
