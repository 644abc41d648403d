"""Readings of numbers, shares, dates and booleans."""

import pytest

from pyspark.sql import functions as F

from quire.functions import normalize as n

NUMBERS = [
    ("42.34-", -42.34), ("4.187.184.13", 4187184.13), ("42   58", None), ("12³", None), ("123 Mio.", 123e6), (" XIV  ", 14), ("165,,", None), ("5.473,04S", -5473.04), (" 362,85H", 362.85),
    ("3,288,50", 3288.5), ("331.500", 331500), ("(118.704)", -118704), ("43.34.34", None), ("9'117, 30", 9117.3), ("9\"117,10", 9117.1), ("-,-", 0), ("--,--", 0), ("€(1.099)", -1099), ("–100", -100),
    ("3.456,814,75", 3456814.75), ("NIL", 0), ("abcdef", None), ("42 58", 42.58), ("4 258  23", 4258.23), ("129.684,46*", 129684.46), ("*(118,704)", -118704), ("*118,704", None), ("034,466416.31", 34466416.31),
    ("0.30.2", None), ("12412..", None), ("0,0-3,0", None), ("1.214141", 1.214141), ("165a", None), ("2.662| ", 2662), ("100 Millionen", 1e8), ("3,444, 40+", 3444.4), ("4,258  23", 4258.23), ("0,00", 0),
]
POSITIVE = [("585,87/-", 585.87), (":2.000, 08 ", 2000.08), ("-O,51", 0.51), ("+159,;03", 159.03), ("42, 975,38", 42975.38), ("1.967.", 1967), ("4.2.", None), ("TWo", 2), ("StringWithkein", None), ("7,375,009+ ", 7375009), ("-2.759,7°", 2759.7)]
SHARES = [("434,27%,", 4.3427), ("12  34  %  .", 0.1234), ("0,0³", None), ("12,34", 0.1234), ("59,00-", 0.59), ("100 %", 1), ("0.0", 0), ("12   34  %  .", None), ("12,34 %;", 0.1234)]
DATES = [
    ("1. November 2019", "2019-11-01"), ("/04.12.", "0000-12-04"), ("07092012", "2012-09-07"), ("24.13.2020", None), ("09/18", "2018-09-01"), ("23.0919", "2019-09-23"), ("0210.19", "2019-10-02"), ("250785", "1985-07-25"),
    ("02.06./ 02.06.", "0000-06-02"), ("30, Juni", "0000-06-30"), ("July 1, 2019", "2019-07-01"), ("13 Mar 2020", "2020-03-13"), ("1993-02-05T00:00:00", "1993-02-05"), ("09.2002", "2002-09-01"), ("Oktober 2011", "2011-10-01"),
    ("2001", "2001-01-01"), ("13.9.2021", "2021-09-13"), ("14132020", None), ("02-05-2019", "2019-05-02"), ("15.02.‚2019", "2019-02-15"), ("23.0K.2010", None), ("05.09;", "0000-09-05"), ("1.August2019", "2019-08-01"), ("30.07.2.90", None),
]
BOOLS = [("nicht vorhanden", False), ("mit Schutzbrief", True), ("alleinstehend ohne Kind", None), ("", None), ("ja", True), ("ohne", False)]


@pytest.mark.parametrize("function, cases", [(n.to_float, NUMBERS), (n.to_positive_float, POSITIVE), (n.to_percentage, SHARES), (n.to_date, DATES), (n.to_bool, BOOLS)])
def test_readings(spark, function, cases):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)] + [(len(cases), None)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", function(F.col("s")).alias("v")).collect()}
    wrong = [(s, want, got[i]) for i, (s, want) in enumerate(cases) if got[i] != (pytest.approx(want) if isinstance(want, float) else want)]
    assert not wrong and got[len(cases)] is None
