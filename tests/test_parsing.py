"""Parsing agrees with the Python standard library on many spellings."""

import random
from datetime import date, timedelta
from decimal import Decimal, InvalidOperation

from pyspark.sql import functions as F

from docproof.functions import parsing as P


def run(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[2:] for r in df.select("i", "s", *cols).orderBy("i").collect()]


def test_dates(spark):
    rng = random.Random(7)
    values = [None, "", " ", "2026-06-01 ", " 2026-06-01", "2026-6-1", "20260601", "0000-01-01",
              "2026-02-29", "2024-02-29", "2026-W53-1", "2020-W53-7", "2026-W00-1", "2026-W54",
              "2026W01", "2026W011", "2026-W01", "2026-W011", "2026W01-1", "2026-W01-0",
              "2026-W01-8", "2026-w01-1", "2026-0601", "202606-01", "2026-06-01T00:00", "2026",
              "9999-W52-5", "9999-W52-6", "9999-W52-7", "0001-W01-1", "0001-01-01", "9999-12-31",
              "2026-06-01\n", "２０２６-06-01", "2026/06/01", "31/02/2026", "2026-13-01", "2026-00-10"]
    for _ in range(3000):
        d = date(1, 1, 1) + timedelta(days=rng.randrange(3652058))
        y, w, wd = d.isocalendar()
        values += [d.isoformat(), d.isoformat().replace("-", ""), f"{y:04d}-W{w:02d}-{wd}",
                   f"{y:04d}W{w:02d}{wd}", f"{y:04d}-W{w:02d}", f"{y:04d}W{rng.randrange(60):02d}",
                   f"{rng.randrange(10000):04d}-{rng.randrange(15):02d}-{rng.randrange(34):02d}"]

    def expected(s):
        try:
            return date.fromisoformat(s) if s else None
        except ValueError:
            return None

    got = run(spark, values, P.parse_iso_date(F.col("s")).cast("string"))
    bad = [(s, g[0], expected(s)) for s, g in zip(values, got)
           if g[0] != (expected(s).isoformat() if expected(s) else None)]
    assert bad == []


def cents(s):
    """Cents after rounding half to even, 'bad' for no number, 'fails' for what cannot be rounded."""
    try:
        d = Decimal(s)
    except InvalidOperation:
        return "bad"
    try:
        q = d.quantize(Decimal("0.01"))
    except InvalidOperation:
        return "fails"
    return str(abs(q)) if q.is_finite() else "fails"


def test_amounts(spark):
    rng = random.Random(8)
    values = ["1", "1.5", ".5", "5.", ".", "", " 1.50\n", "\xa01.50　", "1_000.50", "_1_", "1__2",
              "1,234.50", "-5.005", "+5.015", "0.125", "0.135", "0.1250000000001", "0.1349999999999999",
              "0.125" + "0" * 40, "0.125" + "0" * 40 + "1", "1e3", "1.5E-1", "125E-3", "125000000000001E-15",
              "1.25E-1", "1E+30", "1E-30", "0E+50", "1E", "1e+", "1e1000000000000000000", "1e-99999999999",
              "1e99999999999", "9" * 26, "9" * 27, "9" * 26 + ".994", "9" * 26 + ".995", "0" * 40 + "1.5",
              "NaN", "-nan12", "sNaN", "Infinity", "-inf", "infin", "١٢.٥٠", "1 2", "12 _", "not-a-number",
              "$5", "1.2.3", "--1", "+-1", "0", "-0", "0.005", "0.015", "1e0005", "1_e_5", "\x1c5", "0.00e9"]
    for _ in range(2000):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 20)))
        fraction = "".join(rng.choice("0005") for _ in range(rng.randrange(0, 18)))
        values.append(rng.choice(["", "-", "+"]) + digits + "." + fraction)
        values.append(digits + "." + fraction + f"E{rng.randrange(-30, 12)}")
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    value = F.coalesce(F.abs(P.to_cents(F.col("a"))).cast("string"), F.lit("fails"))
    got = (P.with_amount(df, "s", "a").orderBy("i")
           .select(F.when(~F.col("a_readable"), "bad").otherwise(value)).collect())
    bad = [(v, g[0], cents(v)) for v, g in zip(values, got) if g[0] != cents(v)]
    assert bad == []


def test_days(spark):
    values = ["1", " 30 ", "\xa030", "+5", "-5", "1_0", "1__0", "_1", "1_", "14.0", "Net 30", "", " ", "007",
              "999999999999", "9" * 30, "9" * 4300, "9" * 4301, "1" + "_1" * 4299, "1" + "_1" * 4300,
              "٣٠", "\x1c5", "\x855", "\n5\t", "- 5", "+", "5 ", "0_0"]

    def expected(s):
        try:
            return int(s)
        except ValueError:
            return "bad"

    s = F.col("s")
    got = run(spark, values, P.is_whole_number(s), P.parse_days(s))
    for v, (readable, n) in zip(values, got):
        want = expected(v)
        assert readable == (want != "bad"), v
        if want != "bad":
            assert n == (want if abs(want) < 2**63 else None), v
