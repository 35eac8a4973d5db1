"""Column functions on citations of acts, names, norms and the marked-up body of an act."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

# fixed values: how an act is cited in answers, in the state of a dialogue, and in audits
ACT = r"\b([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\-]{1,14})\s*:?\s*(\d{1,5})\s*/\s*(\d{2,4})"
STATE_ACT = r"\b([A-ZÑ][A-ZÑ0-9-]{2,})\s+(\d{1,6}\s*/\s*\d{2,4})\b"
NORM = r"(?i)\b(RESHCS|RESPRHCS|DISPCD|DISPPCD|RESREC|DISP|RES|ACTDB|RESOL)[A-Z\-]*\s*[:\-]?\s*\d{1,7}\s*[/\-]\s*\d{2,4}"
PORTAL_NUMBER = r"(?i)^\s*([A-ZÑ0-9][A-ZÑ0-9-]*?)\s*[-:]?\s+(\d+)\s*/\s*(\d{2,4})\s*$"
NUMBER = r"(\d{1,6})\s*/\s*(\d{2,4})"
# fixed values: words of institutions, which no person's name holds
INSTITUTIONS = "universidad nacional lujan luján departamento ciencias consejo superior division división direccion dirección secretaria secretaría basicas básicas sociales educacion educación tecnologia tecnología rector rectorado programa plan estudios resolucion resolución disposicion disposición".split()
NAME = r"(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\s+){1,3}[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"
# fixed values: entities of an act by family
ENTITIES = {
    "order": r"(?i)\bORDEN\s+DE\s+COMPRA\b\s*(?:N[°ºRO.:\s]*)?\s*(\d{1,6}\s*/\s*\d{2,4})\b",
    "file": r"(?i)\bEXP-LUJ\b\s*(?:N[°ºRO.:\s]*)?\s*0*(\d+\s*[/\-]\s*\d{2,4})\b",
    "norm": r"(?i)\b(Ley\s+N?[°º]?\s*\d+\.?\d*|(?:Resolución|Disposición)\s+(?:RESHCS|DISPPCD|DISPSECADM|RES|DISP)[A-Z\-]*[:\s]*\d+[-/]\d+)\b",
    "career": r"(?i)\b(Licenciatura\s+en\s+[A-Za-záéíóúüñ\s]+|Ingeniería\s+[A-Za-záéíóúüñ\s]+|Profesorado\s+en\s+[A-Za-záéíóúüñ\s]+)\b",
    "course": r"(?i)\b(?:Asignatura|Materia|Curso)?\s*[:\-]?\s*\(?(\d{5})\)?\s*[\-.–]?\s*[A-ZÁÉÍÓÚ][A-Za-záéíóúüñI\s]+(?:[,;.\n]|$)",
    "code": r"(?i)\b((?:EXP-LUJ|ACTDB-LUJ|EXPP|DISPCD-TLUJ|DISPCD-T|RESHCS-LUJ|RESPHCS|SEACAD|[A-Z]{3,}(?:-[A-Z0-9]+)*)\s*(?:[:\-–—]|N[°º.:\s]+)?\s*\d+[/\-]\d{2,4})\b",
}
# fixed values: words of a signer's role, and what no role holds
ROLE_WORDS = r"(?:president[ea]|vicepresident[ea]|rector(?:a)?|secretari[oa]|subsecretari[oa]|director(?:a)?|decano|coordinador(?:a)?|jefe|responsable|vicedirector(?:a)?)"
NO_ROLE = r"(https?://|doi\.org|[•●]|bibliograf|revista|jornadas|tesis|anexo|art[ií]culo)"
# fixed values: headers, formulas and noise of a body in Markdown
HEADER = r"(?m)^(#{1,3}[ \t]+\S.*)$"
ARTICLE = r"(?mi)^###\s+Art[íi]culo"
FORMULA = r"(?m)^##\s+(EL|LA|LOS|LAS)\s+[A-ZÁÉÍÓÚÑ\s.]{10,}$"
BODY_NOISE = {"letterhead": r"(?i)Universidad Nacional de Luj[áa]n\s+Departamento de", "disclaimer": r"(?i)no tendr[áa] validez|sin autenticaci[óo]n|sitio Web de la Universidad", "closing": r"(?i)Reg[íi]strese,?\s+(comun[íi]quese|notif[íi]quese)"}
CUT = "\x01"


def full_year(y: Column) -> Column:
    """Two digits of a year over 50 are of the last century."""
    return F.when(F.length(y) == 2, F.concat(F.when(y > "50", F.lit("19")).otherwise(F.lit("20")), y)).otherwise(y)


def _java(pattern: str) -> str:
    """Case is ignored for all letters, not those of ASCII only."""
    return pattern.replace("(?i)", "(?iu)").replace("(?mi)", "(?miu)")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_java(pattern)), F.lit(group))


def acts_of(text: Column) -> Column:
    """Distinct acts `CODE number/year` of a text: zeros in front of a number go, years have four digits."""
    part = lambda x, k: F.regexp_extract(x, ACT, k)
    return F.array_distinct(F.transform(_all(text, ACT), lambda x: F.concat(part(x, 1), F.lit(" "), F.regexp_replace(part(x, 2), "^0+", ""), F.lit("/"), full_year(part(x, 3)))))


def state_acts(text: Column) -> Column:
    """Distinct `CODE number/year` as the state of a dialogue keeps them: codes of three characters at least, white space in the number goes."""
    part = lambda x, k: F.regexp_extract(x, STATE_ACT, k)
    return F.array_distinct(F.transform(_all(text, STATE_ACT), lambda x: F.concat(part(x, 1), F.lit(" "), F.regexp_replace(part(x, 2), r"\s", ""))))


def norm_families(text: Column) -> Column:
    """The distinct families of norms that a text cites, as written; not single norms."""
    return F.array_distinct(_all(text, NORM, 1))


def person_names(text: Column) -> Column:
    """Runs of two to four capitalised words that open no sentence and hold no word of institutions."""
    found = _all(F.concat(F.lit(" "), text), r"(?<![.\n¿¡])\s(" + NAME + ")", 1)
    names = F.transform(found, lambda n: F.regexp_replace(F.trim(n), r"\s+", " "))
    return F.filter(names, lambda n: ~F.exists(F.split(n, " "), lambda w: fold(w).isin([_plain(x) for x in INSTITUTIONS])))


def _plain(word: str) -> str:
    return word.translate(str.maketrans("áéíóúñ", "aeioun"))


def split_number(text: Column) -> Column:
    """(code, number, year) of a portal's number: the separator may be - or : or lack; two digits of a year mean 20yy. Nulls where the form is another."""
    part = lambda k: F.regexp_extract(text, _java(PORTAL_NUMBER), k)
    ok = F.coalesce(text, F.lit("")).rlike(_java(PORTAL_NUMBER))
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.lit("20"), part(3)))
    return F.struct(F.when(ok, F.upper(part(1))).alias("code"), F.when(ok, F.concat_ws("/", part(2), part(3))).alias("number"), F.when(ok, year.cast("int")).alias("year"))


def ungrounded(answer: Column, citations: Column, texts: Column) -> Column:
    """The acts that an answer cites and neither a retrieved citation nor a retrieved text (arrays of strings) names."""
    named = lambda a: F.flatten(F.transform(a, acts_of))
    return F.array_except(acts_of(answer), F.concat(named(citations), named(texts)))


def resolve(citation: Column, sources: Column) -> Column:
    """The place, from 0, of the source that a citation means, or -1: the same text without accents, else the act's number (the only one, else the one of the
    same section, else the first), else the first one that holds the citation or is held by it."""
    none = F.lit(-1)
    target, plain = fold(citation), F.transform(sources, fold)
    at = lambda keep: F.filter(F.sequence(F.lit(0), F.size(sources) - 1), keep)
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), none)
    key = F.when(citation.rlike(NUMBER), F.concat(F.regexp_extract(citation, NUMBER, 1), F.lit("/"), F.regexp_extract(citation, NUMBER, 2)))
    numbered = at(lambda i: F.coalesce(F.contains(F.regexp_replace(F.get(sources, i), r"\s+", ""), key), F.lit(False)))
    section = lambda x: fold(F.trim(F.split_part(x, F.lit("—"), F.lit(2))))
    same = F.filter(numbered, lambda i: (section(citation) != "") & (section(F.get(sources, i)) == section(citation)))
    mutual = at(lambda i: F.contains(F.get(plain, i), target) | F.contains(target, F.get(plain, i)))
    exact = F.array_position(plain, target) - 1
    by_number = F.when((F.size(numbered) > 1) & (F.size(same) > 0), first(same)).otherwise(first(numbered))
    found = F.when(exact >= 0, exact).when(F.size(numbered) > 0, by_number).otherwise(first(mutual))
    return F.when(F.coalesce(F.size(sources), F.lit(0)) < 1, none).otherwise(found).cast("int")


def entities(text: Column, family: str) -> Column:
    """Distinct entities of a family in a text, white space in them as one space."""
    return F.array_distinct(F.transform(_all(text, ENTITIES[family], 1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def clean_role(role: Column) -> Column:
    """A signer's role with single spaces, without marks at its ends, and with a capital in front."""
    r = F.regexp_replace(F.regexp_replace(F.coalesce(role, F.lit("")), r"\s+", " "), r"^[ .:\-\t]+|[ .:\-\t]+$", "")
    return F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))


def valid_role(role: Column) -> Column:
    """A role of at most 180 characters that holds a word of roles and none of references."""
    r = clean_role(role)
    return (r != "") & (F.lower(r) != "unknown") & (F.length(r) <= 180) & ~r.rlike("(?iu)" + NO_ROLE) & r.rlike(rf"(?iu)\b{ROLE_WORDS}\b")


# fixed values: the steps that make an issuer of the words in front of an act's decision, in this order
ISSUER_STEPS = [
    (r"(?i)\bD\s*I\s*S\s*P\s*O\s*N\s*E\b.*$", ""),
    (r"(?i)\bR\s*E\s*S\s*U\s*E\s*L\s*V\s*E\b.*$", ""),
    (r"(?i)^(?:por\s+ello[,;:]?\s*)+", ""),
    (r"(?i)^(?:el|la)\s+", ""),
    (r"(?i)\s+DE\s+LA\s+UNIVERSIDAD\s+NACIONAL\s+DE\s+LUJ[ÁA]N\s*$", ""),
    (r"(?i)\s+UNIVERSIDAD\s+NACIONAL\s+DE\s+LUJ[ÁA]N.*$", ""),
    (r"(?i)\s+DE\s+LA\s*$", ""),
    (r"(?i)^DIRECTOR(?:A)?\s+GENERAL\b", "DIRECCION GENERAL"),
    (r"(?i)^SECRETARIO\b", "SECRETARIA"),
    (r"(?i)^SUBSECRETARIO\b", "SUBSECRETARIA"),
    (r"(?i)^SECRETARIA\s+ACAD[ÉE]MICO\b", "SECRETARIA ACADÉMICA"),
]


def issuer(words: Column, kind: Column) -> Column:
    """The issuing body in capitals: what follows the decision and what stands around the body goes; a rector is named by the kind of the act."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = flat(words)
    for pattern, to in ISSUER_STEPS:
        out = F.regexp_replace(out, _java(pattern), to)
    rector = F.when(kind == "resolucion", "RESOLUCION RECTOR").otherwise("DISPOSICION RECTOR")
    return F.when(out.rlike(r"(?iu)^RECTOR(?:A)?\s*(?:DE\s+LA\s+UNIVERSIDAD)?"), rector).otherwise(F.upper(flat(out)))


def chunkability(body: Column) -> list[Column]:
    """Metrics of a body in Markdown: headers by level, articles, the prefix that no header covers, the largest section, noise, families of norms."""
    count = lambda p: F.regexp_count(body, F.lit(_java(p)))
    level = lambda k: count(r"(?m)^#{%d}[ \t]+\S.*$" % k)
    parts = F.split(F.regexp_replace(body, HEADER, CUT + "$1"), CUT)
    sections = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    orphan = F.length(F.regexp_replace(F.get(parts, F.lit(0)), r"^\s+|\s+$", ""))
    noise = [count(p).alias(n) for n, p in BODY_NOISE.items()]
    return [count(HEADER).alias("headers"), *[level(k).alias(f"h{k}") for k in (1, 2, 3)], count(ARTICLE).alias("articles"), orphan.alias("orphan"), F.coalesce(F.array_max(sections), F.lit(0)).alias("largest"), count(FORMULA).alias("formulas"), *noise, F.size(norm_families(body)).alias("families")]


def titles(body: Column) -> Column:
    """The headers' words."""
    return F.transform(_all(body, HEADER, 1), lambda h: F.trim(F.regexp_replace(h, r"^#{1,3}[ \t]+", "")))
