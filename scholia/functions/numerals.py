"""Chinese numerals and the numbers of chapter and section titles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: digits, units and the form of numbered titles
DIGITS = "零一二三四五六七八九"
UNITS = (("千", 1000), ("百", 100), ("十", 10))
NUMERAL = "零〇一二两三四五六七八九十百千0-9"


def number(c: Column) -> Column:
    """The value of a numeral up to 9999: digits, Chinese digits by place (一〇五), or with units (一百零五, 十二); null for others."""
    s = F.translate(c, "〇两", "零二")
    digit = lambda x: F.instr(F.lit(DIGITS), x) - 1
    with_units = F.lit(0)
    for unit, value in UNITS:
        before = F.regexp_extract(s, f"([一二三四五六七八九]?){unit}", 1)
        with_units = with_units + F.when(F.contains(s, F.lit(unit)), F.when(before == "", 1).otherwise(digit(before)) * value).otherwise(0)
    last = F.regexp_extract(s, "([一二三四五六七八九])$", 1)
    with_units = with_units + F.when(last == "", 0).otherwise(digit(last))
    plain = F.translate(s, DIGITS, "0123456789")
    form = "^(([一二三四五六七八九]?千)?零?([一二三四五六七八九]?百)?零?([一二三四五六七八九]?十)?零?[一二三四五六七八九]?)$"
    return F.when(plain.rlike("^[0-9]{1,4}$"), plain.try_cast("int")).when((s != "") & s.rlike(form), with_units)


def titled_number(title: Column, kind: str) -> Column:
    """n of titles that begin with 第n``kind`` (章, 节)."""
    return number(F.nullif(F.regexp_extract(title, f"^第([{NUMERAL}]+){kind}", 1), F.lit("")))
