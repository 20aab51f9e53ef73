"""Text normalisation for codes, streets and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks, and what they fold to.
MARKED = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
ROAD_WORDS = ("avenida", "calle", "calzada", "callejon", "cerrada", "circuito", "eje", "paseo", "privada", "viaducto")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def plain(c: Column) -> Column:
    """Without marks, lower case, runs of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, MARKED, PLAIN)), "[^a-z0-9]+", " "))


def station_code(c: Column) -> Column:
    """Three digits at least; codes in pairs and with letters stay."""
    bare = F.trim(F.btrim(F.trim(c), F.lit('"')))
    return F.when(bare.rlike("^[0-9]+$") & (F.length(bare) < 3), F.lpad(bare, 3, "0")).otherwise(bare)


def house_number(c: Column) -> Column:
    """Digits and one letter at most, else empty."""
    return F.upper(F.regexp_extract(F.trim(c), "^([0-9]+ ?[A-Za-z]?)$", 1))


def street_label(kind: Column, name: Column) -> Column:
    """The kind before the name, unless the name begins with a road word."""
    first = F.element_at(F.split(plain(name), " "), 1)
    return F.when(first.isin(*ROAD_WORDS) | (F.coalesce(kind, F.lit("")) == ""), name).otherwise(F.concat_ws(" ", kind, name))


def month_of_name(c: Column) -> Column:
    """YYYY-MM from a file name: a year with a numeric month, else with the Spanish month's name behind an underscore; else null."""
    number = lambda k: F.regexp_extract(c, r"(20\d{2})[-_](0[1-9]|1[0-2])(?!\d)", k)
    word = lambda k: F.regexp_extract(F.lower(c), rf"(20\d{{2}})_({'|'.join(MONTHS)})", k)
    months = F.create_map(*(F.lit(x) for n, m in enumerate(MONTHS, 1) for x in (m, f"{n:02d}")))
    return F.when(number(0) != "", F.concat_ws("-", number(1), number(2))).when(word(0) != "", F.concat_ws("-", word(1), F.try_element_at(months, word(2))))


def words_of(text: Column) -> Column:
    """The different words of a text, folded."""
    return F.array_distinct(F.filter(F.split(plain(text), " "), lambda t: t != ""))


def code_parts(code: Column) -> Column:
    """A paired code and its halves."""
    return F.array_union(F.array(code), F.split(code, "-"))
