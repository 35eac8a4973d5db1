"""Column functions on titles, citations of known acts, file names, cities, commands, glossaries and written dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

# fixed values: the genres of acts by their plain first word
GENRES = {"disposicion": "Disposición", "resolucion": "Resolución", "ordenanza": "Ordenanza", "acta": "Acta", "nota": "Nota", "providencia": "Providencia", "orden": "Orden de compra"}
# fixed values: months by their first letters, particles of city names, commands, types of entities, weights of origins
MONTHS = {"ene": "01", "feb": "02", "mar": "03", "abr": "04", "may": "05", "jun": "06", "jul": "07", "ago": "08", "sep": "09", "set": "09", "oct": "10", "nov": "11", "dic": "12"}
PARTICLES = ("de", "del", "la", "las", "los", "y")
COMMANDS = ("listado", "novedades", "comparar", "ficha", "resumen")
ENTITY_TYPES = ("persona", "carrera", "departamento", "organo", "acto")
WEIGHTS = {"sistema": 0.5, "usuario": 1.0, "descartado": 0.0}
SECTION_LENGTH = 60
ANNEX = r"(?i)^(anexo\s*[IVXLC0-9]*)"
IDENTITY_NAME = r"^[A-ZÑ0-9]+(-[A-ZÑ0-9]+)*_\d+$"
COMMAND = r"(?s)^/(\w+)(?:\s+(.+))?$"
NO_TOPIC = "normativa publicada recientemente"


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def genre(kind: Column) -> Column:
    """The genre of an act by the first word of its kind, else that word with a capital."""
    first = F.regexp_extract(flat(F.coalesce(kind, F.lit("documento"))), r"^\S+", 0)
    first = F.when(first == "", "documento").otherwise(first)
    plain = F.translate(F.lower(first), "óíáéú", "oiaeu")
    return F.coalesce(F.try_element_at(_map(GENRES), plain), capital(first))


def shorten(title: Column, most: int = SECTION_LENGTH) -> Column:
    """Single spaces; where it is longer, cut at the last space, with an ellipsis."""
    t = flat(title)
    head = F.substring(t, 1, most)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("…")))


def citation(kind: Column, code: Column, number: Column, title: Column, part: Column, annex: Column) -> Column:
    """Genre, code and number without what is unknown, and the part of the act; a part inside an annex names the annex."""
    known = lambda c: F.when((F.coalesce(c, F.lit("")) != "") & (F.lower(c) != "unknown"), c)
    head = F.trim(F.concat_ws(" ", known(genre(kind)), known(code), known(number)))
    head = F.concat(F.upper(F.substring(head, 1, 1)), F.substr(head, F.lit(2)))
    t, dash = shorten(title), F.lit(" — ")
    inside = F.concat(head, dash, F.coalesce(F.nullif(annex, F.lit("")), F.lit("Anexo")), F.lit(", "), t)
    alone = F.when(head == "", "documento sin identificar").otherwise(head)
    return F.when((F.coalesce(title, F.lit("")) == "") | (part == "otra"), alone).when((part == "anexo") & ~F.startswith(F.lower(t), F.lit("anexo")), inside).otherwise(F.concat(head, dash, t))


def annex_name(title: Column) -> Column:
    """The annex that a heading names, without the rest of its title."""
    second = F.get(F.split(flat(F.regexp_extract(F.trim(title), ANNEX, 1)), " "), F.lit(1))
    return F.concat(F.lit("Anexo"), F.coalesce(F.concat(F.lit(" "), F.upper(second)), F.lit("")))


def catalogue_citation(kind: Column, code: Column, number: Column, year: Column, suffix: Column) -> Column:
    """Kind by words, code and number/year, and a suffix; null without a number or a year."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    kind = F.initcap(t(F.when(F.coalesce(kind, F.lit("")) == "", "Acto").otherwise(kind)))
    base = F.concat_ws(" ", F.nullif(kind, F.lit("")), F.nullif(F.upper(t(code)), F.lit("")), F.concat_ws("/", t(number), t(year)))
    return F.when((t(number) != "") & (t(year) != ""), F.concat_ws(" — ", base, F.nullif(F.coalesce(suffix, F.lit("")), F.lit(""))))


def section_of_file(name: Column) -> Column:
    """The section in a file's name without its running number; empty for names in lower case or in the form of an act's identity."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"_\d+$", "")
    return F.when((stem == F.upper(stem)) & ~stem.rlike(IDENTITY_NAME), stem).otherwise("")


def city(value: Column) -> Column:
    """Names parted by commas, words with capitals but for particles inside, and the accent of a known city; unknown where nothing is left."""
    parts = F.filter(F.transform(F.split(flat(value), ","), lambda p: F.trim(p)), lambda p: p != "")
    words = lambda p: F.transform(F.split(p, " "), lambda w, k: F.when((k > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(capital(w)))
    named = F.transform(parts, lambda p: F.when(F.upper(p) == "LUJAN", "Luján").otherwise(F.array_join(words(p), " ")))
    return F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("unknown")


def command(text: Column) -> Column:
    """(mode, days, question) of a command of the list; nulls for other texts, and for commands without a topic that need one."""
    mode, rest = F.lower(F.regexp_extract(text, COMMAND, 1)), F.trim(F.regexp_extract(text, COMMAND, 2))
    news = mode == "novedades"
    days = F.when(news, F.nullif(F.regexp_extract(rest, r"(?s)^(\d{1,3})\s*(.*)$", 1), F.lit("")).cast("int"))
    rest = F.when(days.isNotNull(), F.trim(F.regexp_extract(rest, r"(?s)^(\d{1,3})\s*(.*)$", 2))).otherwise(rest)
    ok = mode.isin(*COMMANDS) & (news | (rest != ""))
    return F.struct(F.when(ok, mode).alias("mode"), F.when(ok, days).alias("days"), F.when(ok, F.when(rest == "", NO_TOPIC).otherwise(rest)).alias("question"))


def expanded(question: Column, glossary: str) -> Column:
    """The question, and in parentheses the terms of those lines `left → right, right` whose left side it holds, each once and only if it lacks them."""
    base = fold(question)
    terms = F.array().cast("array<string>")
    for line in glossary.replace("->", "→").splitlines():
        left, arrow, right = (x.strip() for x in line.partition("→"))
        new = [x.strip() for x in right.split(",") if x.strip()]
        if arrow and left and new:
            lacking = F.filter(F.array(*map(F.lit, new)), lambda x: ~F.contains(base, fold(x)))
            terms = F.when(F.contains(base, fold(F.lit(left))), F.array_union(terms, lacking)).otherwise(terms)
    return F.when(F.size(terms) > 0, F.concat(question, F.lit(" ("), F.array_join(terms, ", "), F.lit(")"))).otherwise(question)


def clean_name(c: Column) -> Column:
    """Plain capitals and digits, all else as single hyphens."""
    return F.upper(F.regexp_replace(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def file_stem(code: Column, number: Column, year: Column, file_id: Column) -> Column:
    """The name of an act's file by its identity, or by its file id where it has none."""
    full = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    base = F.concat_ws("_", full(clean_name(code)), full(number), full(year))
    return F.when(base == "", F.substring(clean_name(file_id), 1, 16)).otherwise(base)


def slug(title: Column) -> Column:
    """The id of a document by its heading, `res_` or `disp_` and the rest with underscores; null for other headings."""
    pattern = r"(?iu)#\s*(Resolución|Disposición|Resolucion|Disposicion)\s+(.*)"
    kind, rest = F.lower(F.regexp_extract(title, pattern, 1)), F.lower(F.regexp_extract(title, pattern, 2))
    rest = F.regexp_replace(F.regexp_replace(rest, r"[\s/\-:.]+", "_"), "^_+|_+$", "")
    return F.when(title.rlike(pattern), F.concat(F.when(F.contains(kind, F.lit("res")), "res_").otherwise("disp_"), rest))


def written_date(day: Column, month: Column, year: Column) -> Column:
    """ISO date of a day, a month in digits or letters, and a year; two digits of a year mean 20yy. Days up to 31 in any month; null where a part is wrong."""
    y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
    m = F.when(month.rlike(r"^\d+$"), F.lpad(month, 2, "0")).otherwise(F.try_element_at(_map(MONTHS), F.substring(F.lower(month), 1, 3)))
    ok = day.try_cast("int").between(1, 31) & m.try_cast("int").between(1, 12)
    return F.when(ok, F.concat(y, F.lit("-"), m, F.lit("-"), F.lpad(day, 2, "0")))


def issue_date(dates: Column, number: Column, head: Column) -> Column:
    """Of the dates found the earliest of the year in the act's number; else the one in its head, or the earliest of that month; else the first, or unknown."""
    dates = F.filter(F.coalesce(dates, F.array().cast("array<string>")), lambda x: F.length(x) >= 4)
    yy = F.regexp_extract(F.coalesce(number, F.lit("")), r"[/\-]\s*(\d{2,4})\s*$", 1)
    year = F.when(yy != "", F.when(yy.try_cast("int") < 100, yy.try_cast("int") + 2000).otherwise(yy.try_cast("int")).cast("string"))
    same = F.array_min(F.filter(dates, lambda x: F.substring(x, 1, 4) == year))
    pattern = r"(?iu)(\d{1,2})\s*[ºo°]?\s+DE\s+([A-ZÁÉÍÓÚ]+)\s+DE\s+(\d{4})"
    first = F.array_join(F.slice(F.split(F.coalesce(head, F.lit("")), "\n"), 1, 12), "\n")
    part = lambda k: F.regexp_extract(first, pattern, k)
    target = written_date(part(1), part(2), part(3))
    month = F.array_min(F.filter(dates, lambda x: F.startswith(x, F.substring(target, 1, 7))))
    return F.coalesce(same, F.when(F.array_contains(dates, target), target), month, F.get(dates, F.lit(0)), F.lit("unknown"))
