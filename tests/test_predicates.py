"""Table-driven checks of the predicates, and a comparison with plain Python on random text."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docproof.functions import predicates as P, text as X
from docproof.operators.grounding import encode_digits, encoded_amount_pattern

C = F.col


def answers(spark, rows, schema, check):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(check).collect()]


def iban(country, bban):
    """An account with the check digits that its country and number ask for."""
    rest = int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97
    return f"{country}{98 - rest:02d}{bban}"


def spoilt(account):
    return account[:-1] + str((int(account[-1]) + 1) % 10)


AUSTRIAN = iban("AT", "2011100055512345")
UNLISTED = iban("QZ", "HAFN000987654321")
IBANS = [
    (AUSTRIAN, True), (spoilt(AUSTRIAN), False), (AUSTRIAN.lower(), True), (AUSTRIAN[:-1], False), (AUSTRIAN + "0", False),
    (" ".join(AUSTRIAN[i:i + 4] for i in range(0, 20, 4)), True), ("-".join([AUSTRIAN[:4], AUSTRIAN[4:]]), False),
    (AUSTRIAN[2:], False), (AUSTRIAN + "\n", False), (UNLISTED, True), (spoilt(UNLISTED), False),
    (iban("QZ", "5" * 10), False), (iban("QZ", "5" * 31), False), (iban("GB", "WXYZ01020398765432"), True),
    (iban("FR", "4455566677A8899B0011223"), True), (iban("MT", "QRST54321AB12CD34EF56GH78IJ"), True),
    (iban("NO", "12345678903"), True), ("", False), (None, False), ("40 50 60", False),
]


def test_iban(spark):
    got = answers(spark, [(a,) for a, _ in IBANS], "a string", F.struct(
        P.is_valid_iban(C("a")), P.is_iban_like(C("a")), P.iban_check_fails(C("a"))))
    assert [g[0] for g in got] == [want for _, want in IBANS]
    shape = re.compile(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    assert [g[1] for g in got] == [bool(a) and bool(shape.match(a.replace(" ", "").upper())) for a, _ in IBANS]
    assert not any(g[2] for g in got)


def test_iban_line_feed_reaches_checksum(spark):
    rows = [(UNLISTED + "\n",), (AUSTRIAN[:-1] + "\n",), (AUSTRIAN + "\n",)]
    assert answers(spark, rows, "a string", P.iban_check_fails(C("a"))) == [True, True, False]


def test_tables_can_be_extended(spark):
    rows = [(UNLISTED,)]
    assert answers(spark, rows, "a string", P.is_known_iban_country(C("a"), {"QZ": 20})) == [True]
    assert answers(spark, rows, "a string", P.is_valid_iban(C("a"), {"QZ": 24})) == [False]
    assert answers(spark, rows, "a string", P.lookup_country_length(C("a"), {"QZ": 20})) == [20]
    assert answers(spark, [("XYZ",)], "c string", P.is_valid_currency_code(C("c"), {"XYZ"})) == [True]


@pytest.mark.parametrize("code,known", [
    ("SEK", True), ("JPY", True), ("CHF", True), ("chf", False), ("CH", False), ("CHFR", False), ("C F", False),
    ("QQQ", False), ("", False), (None, False), ("SEK,JPY", False), ("JPY ", False)])
def test_currency(spark, code, known):
    assert answers(spark, [(code,)], "c string", P.is_valid_currency_code(C("c"))) == [known]


def normalized(s):
    return re.sub(r"[\s,.\-/]", "", s).upper()


def test_grounding_table(spark):
    rows = [
        ("Lot 44/b", "see lot 44/b below", True), ("Lot 44/b", "LOT\t4 4\nB", True), ("Lot 44/b", "Lot 45/b", False),
        (AUSTRIAN, f"to {spoilt(AUSTRIAN)}", False), ("x", "", False), ("x", None, False), ("", "x", False), (None, "x", False),
        (". -", "anything", True),
        ("a" * 300, "A " * 300, True), ("a" * 300, "A " * 299, False), ("Straße", "STRASSE", True),
        ("STRASSE", "Straße", True), ("k", "\u212a", False), ("(a+b)*[c]\\d", "x (A+ B)*[C ]\\ D", True),
        ("ŻÓŁĆ", "żół ć", True), ("a b", "A　B", True),
    ]
    got = answers(spark, rows, "v string, t string, e boolean", P.is_grounded(C("v"), C("t")))
    assert got == [r[2] for r in rows]


def test_grounding_random(spark):
    rng = random.Random(3)
    alphabet = "aAbBkK1 ,.-/\n\xa0\u3000ßſı\u212aéÉ_()$"
    rows = []
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30)))
        i = rng.randrange(len(t))
        v = t[i:i + rng.randrange(1, 8)]
        v = rng.choice([v, v.upper(), v.lower(), normalized(v) or "a", v.replace(" ", "-"), v + "1"])
        rows.append((v, t))
    got = answers(spark, rows, "v string, t string", P.is_grounded(C("v"), C("t")))
    want = [bool(v) and normalized(v) in normalized(t) for v, t in rows]
    assert [(r, g, w) for r, g, w in zip(rows, got, want) if g != w] == []


def test_other_blanks_are_found_without_a_pattern(spark):
    long = "DE89" * 100
    rows = [(long, "to " + " ".join(long[i : i + 4] for i in range(0, 400, 4)), True), (" D E", "xDEx", True),
            (" ", "a", True), ("a b", "a\tB", True), ("ab", "a c b", False), (None, "a", False), ("a", None, False)]
    got = answers(spark, [r[:2] for r in rows], "v string, t string", P.quick_grounding(C("v"), C("t")))
    assert got == [r[2] for r in rows]


def amount_in(amount, text):
    """Plain restatement: integer digits with gaps, one mark, cents together, no digit around."""
    digits = str(int(amount.scaleb(2)))
    whole, cents = digits[:-2] or "0", digits[-2:]
    gap = r"[\s.,_]*"
    return re.search(rf"(?<!\d){gap.join(whole)}[\s_]*[.,][\s_]*{cents}(?!\d)", text) is not None


AMOUNTS = [
    ("87.20", "pay 87.20 now", True), ("87.20", "pay 87,20 now", True), ("87.20", "pay 87.2 now", False), ("87.20", "87.205", False),
    ("87.20", "187.20", False), ("87.20", "1 87.20", True), ("87.20", "87 . 20", True), ("87.20", "87..20", False),
    ("87.20", "8720", False), ("6543210.99", "6.543.210,99", True), ("6543210.99", "6 5 4 3 2 1 0 . 9 9", False),
    ("6543210.99", "6'543'210.99", False), ("6543210.99", "6_543_210_,_99", True), ("40.00", "40", False), ("0.70", "0.70", True),
    ("0.70", ".70", False), ("0.03", "0.03", False), ("0.03", "0.3", True), ("87.20", "", False),
    ("9.00", "٤9.00", False), ("9.00", "9.00٤", False),
]


def test_amount_table(spark):
    rows = [(Decimal(a), t) for a, t, _ in AMOUNTS]
    got = answers(spark, rows, "a decimal(38,2), t string", P.is_amount_grounded(C("a"), C("t")))
    assert got == [want for _, _, want in AMOUNTS] == [amount_in(*r) for r in rows]
    strict = P.is_amount_grounded(C("a"), C("t"), strict_cents=True)
    assert answers(spark, [(Decimal("0.05"), "0.05")], "a decimal(38,2), t string", strict) == [True]
    assert answers(spark, [(Decimal("0.05"), None)], "a decimal(38,2), t string", P.is_amount_grounded(C("a"), C("t"))) == [False]


def test_amount_random(spark):
    """The search in the text and the search in the encoded text agree with plain Python."""
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        a = Decimal(rng.randrange(0, 10 ** rng.randrange(1, 6))).scaleb(-2)
        t = "".join(rng.choice("x1 .,_ ") for _ in range(rng.randrange(6)))
        for ch in f"{a:.2f}":
            t += ch + "".join(rng.choice(" .,_9x\n") for _ in range(rng.choice([0, 0, 0, 0, 1, 2])))
        rows.append((a, t.replace(".", rng.choice(".,"))))
    whole, cents = P.whole_and_cents(C("a"))
    both = F.struct(
        P.is_amount_grounded(C("a"), C("t")),
        F.rlike(F.concat(encode_digits(C("t")), F.lit("x")), encoded_amount_pattern(whole, cents)),
    )
    got = answers(spark, rows, "a decimal(38,2), t string", both)
    want = [amount_in(*r) for r in rows]
    assert 100 < sum(want) < 3900
    assert [(r, tuple(g), w) for r, g, w in zip(rows, got, want) if tuple(g) != (w, w)] == []


def test_text_layer_and_whitespace(spark):
    rows = [("Invoice", True), ("", False), ("   \n\t  ", False), (None, False), (X.WS_CHARS, False), ("​", True)]
    assert answers(spark, [r[:1] for r in rows], "t string", P.has_text_layer(C("t"))) == [r[1] for r in rows]
    assert answers(spark, [(X.WS_CHARS + "a b" + X.WS_CHARS,)], "t string", X.strip(C("t"))) == ["a b"]
