"""Column functions on text: folding, tokens, identifiers, mentions, sections, dates."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented letters and their plain forms
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"
# fixed values: stop-words
STOP = "a al como con de del el en entre es esta estas este estos ha han la las lo los mas o para pero por que se ser son sobre su sus un una y".split()
# fixed values: the token patterns, tried in this order
TOKEN_PATTERNS = [
    r"[A-ZÑ]{2,}[A-ZÑ0-9-]*\s*:\s*\d+\s*[-/]\s*\d{2,4}",
    r"\d+\s*/\s*\d{2,4}",
    r"[A-ZÑ]{2,}[A-ZÑ0-9]*(?:-[A-ZÑ0-9]+)+",
    r"[a-zñáéíóú0-9]+(?:-[a-zñáéíóú0-9]+)*",
]
TOKENS = "(?i)" + "|".join(f"(?:{p})" for p in TOKEN_PATTERNS)
# the same patterns with possessive quantifiers: no run of letters is tried in all its splits
FAST_TOKENS = "(?iu)" + "|".join(
    [
        r"(?:[A-ZÑ]{2,}+[A-ZÑ0-9-]*+\s*+:\s*+\d++\s*+[-/]\s*+\d{2,4}+)",
        r"(?:\d++\s*+/\s*+\d{2,4}+)",
        r"(?:[A-ZÑ]{2,}+[A-ZÑ0-9]*+(?:-[A-ZÑ0-9]++)++)",
        r"(?:[a-zñáéíóú0-9]++(?:-[a-zñáéíóú0-9]++)*+)",
    ]
)
# between tokens that are folded in one go; no token holds it
MARK = "\x01"
# fixed values: white space of a pattern, and the spaces that trimming takes (Unicode's Zs)
WHITE = r"[\t\n\f\r ]"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# fixed value: headings without content
NOISE = r"(?i)^(universidad nacional|rep[uú]blica argentina|p[aá]gina\s*\d|fecha\s*:|lugar de entrega\s*:|expediente\s*n?[°º]?\s*:|ap proveedor|\d+\s*/\s*\d+\s*$)"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


@cache
def _capitals() -> tuple[str, str]:
    """Letters and their capitals, one for one; letters whose capital takes more than one letter have none, but ß has ẞ."""
    one = lambda c: "ẞ" if c == "ß" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
    pairs = [(c, one(c)) for c in map(chr, range(0x110000)) if not c.isascii() or c.islower()]
    low, up = zip(*[(c, u) for c, u in pairs if c != u], strict=True)
    return "".join(low), "".join(up)


def upper(text: Column) -> Column:
    """Capitals letter for letter, as DuckDB has them. Spark's own upper writes ß as SS, which makes one text of two and sorts it elsewhere."""
    return F.translate(text, *_capitals())


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Comparable tokens; a token with / or : is followed by its parts. All tokens of a text are folded at once; parts are looked for only where there are any."""
    found = F.array_join(F.regexp_extract_all(text, F.lit(FAST_TOKENS), F.lit(0)), MARK)
    joined = F.translate(F.lower(found), ACCENTED + " \t\n\x0b\f\r", PLAIN)  # white space inside a token goes
    ok = lambda t: (F.length(t) >= 2) & ~t.isin(STOP)
    plain = F.filter(F.split(joined, MARK), ok)
    parts = lambda t: F.when(t.rlike("[:/]"), F.concat(F.array(t), F.filter(F.split(t, "[:/]"), ok))).otherwise(F.array(t))
    return F.when(joined.rlike("[:/]"), F.flatten(F.transform(plain, parts))).otherwise(plain)


def act_ids(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: t.rlike(r"^\d{1,6}/\d{4}$"))


def identity(citation: Column) -> Column:
    """The head before the em dash."""
    return F.lower(F.trim(F.split_part(citation, F.lit("—"), F.lit(1))))


def mentions_loose(text: Column, pieces: Column) -> Column:
    return F.size(F.filter(pieces, lambda p: F.contains(text, p))) >= F.least(F.lit(2), F.size(pieces))


def mentions_strict(text: Column, pieces: Column, window: int = 40) -> Column:
    """Every piece starts within `window` characters of one occurrence of the first piece; no piece: false."""
    quoted = lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # one pass over the text: at a start of the first piece look ahead, and back to where another piece starts
    near = lambda p: F.concat(F.lit("(?:(?=.{0,%d}" % window), quoted(p), F.lit(")|(?<=(?="), quoted(p), F.lit(").{1,%d}))" % window))
    pattern = F.concat(F.lit("(?s)(?="), quoted(F.get(pieces, F.lit(0))), F.lit(")"), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), near), ""))
    return F.coalesce((F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(text, p)) & F.regexp_like(text, pattern), F.lit(False))


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def looks_like_table(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: pipes(line) >= 2)) >= 3


def truncate_on_word(text: Column, n: int) -> Column:
    """The first n characters, cut at the last space where that lies beyond n / 2, with a mark."""
    head = F.substring(text, 1, n)
    space = n - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > n // 2), F.substr(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit(" […]")))


def noise(title: Column) -> Column:
    return F.trim(title).rlike(NOISE)


def section_type(title: Column, after_signatures: Column) -> Column:
    t = F.lower(F.trim(title))
    out = F.when(t.isin("firmas", "hoja de firmas"), "firmas").when(t.startswith("anexo"), "anexo")
    out = out.when(after_signatures, F.when(noise(title), "ruido").otherwise("anexo"))
    out = out.when(t.startswith("artículo") | t.startswith("articulo"), "articulo").when(F.contains(t, F.lit("visto")), "visto")
    out = out.when(F.contains(t, F.lit("considerando")) | (t == "que") | t.startswith("que "), "considerando")
    return out.when(F.contains(t, F.lit("resolutiva")) | F.contains(t, F.lit("dispositiva")), "parte_resolutiva").otherwise("otra")


def iso_date(day: Column) -> Column:
    """dd/mm/yyyy to yyyy-mm-dd, else empty."""
    return F.coalesce(F.date_format(F.try_to_date(F.when(F.length(day) == 10, day), "dd/MM/yyyy"), "yyyy-MM-dd"), F.lit(""))
