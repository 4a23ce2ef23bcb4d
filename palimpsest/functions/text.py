"""Scalar functions on text as column expressions; all run inside the JVM.

Names of parameters: a Column in, a Column out.  Nulls give null unless said otherwise.
Those of ``normalized`` take text that ``normalize`` has made.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# First words of a name that designate an act.
ACT_FORMS = ("loi", "reglement", "arrete", "code", "constitution", "convention", "ordonnance", "decret", "directive", "regulation", "traite")

# Words that say of an act that it was amended or coordinated, and forms that they follow.
QUALIFIERS = ("modifiee", "modifiees", "modifie", "modifies", "coordonnee", "coordonnees")
QUALIFIED_FORMS = ("loi", "lois", "reglement", "reglements", "arrete", "arretes", "code", "constitution")

# Forms, adjectives and months of citations by date.
DATED_FORMS = ("loi", "lois", "reglement", "reglements", "arrete", "arretes", "decret", "decrets", "ordonnance", "law", "laws", "act", "acts")
ADJECTIVES = ("grand ducal", "ministeriel", "ministerielle", "communal", "communale")
MONTHS = (
    "janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)

# Participles that make what follows the object of an amendment, and words they reach over.
AMENDING = ("repealing", "amending", "replacing", "supplementing", "abrogeant", "modifiant", "remplacant", "completant")
AMENDING_REACH = 3

# Phrases that ask for a role of documents, in the order in which they are tried.
ROLES = (
    ("implementing regulation", "implementing"),
    ("implementing act", "implementing"),
    ("reglement d execution", "implementing"),
    ("acte d execution", "implementing"),
    ("delegated regulation", "delegated"),
    ("delegated act", "delegated"),
    ("reglement delegue", "delegated"),
    ("acte delegue", "delegated"),
    ("amending regulation", "amending"),
    ("amending act", "amending"),
    ("reglement modificatif", "amending"),
    ("acte modificatif", "amending"),
    ("corrigendum", "corrigendum"),
    ("rectificatif", "corrigendum"),
    ("consolidated", "consolidated"),
    ("consolide", "consolidated"),
)
# Phrases that do so only beside a work that is named.
AMBIGUOUS_ROLES = (("implementing", "implementing"), ("delegated", "delegated"), ("delegue", "delegated"), ("amending", "amending"), ("modificatif", "amending"))

# Words of a spoken question that name nothing, and phrases that refer back.
CONVERSATIONAL = (
    "a", "about", "an", "are", "ce", "ces", "comment", "de", "des", "did", "do", "does", "du", "est", "for", "la", "le", "les", "me", "please", "que", "quel", "quelle",
    "quels", "quelles", "quoi", "show", "the", "tell", "what",
)
REFERENCES = (
    "on the same date", "at the same date", "on that date", "at that date", "the same date", "same date", "that date", "this date",
    "the same law", "same law", "that law", "this law", "the same instrument", "same instrument", "that instrument", "this instrument",
    "a la meme date", "a cette date", "la meme date", "cette date", "la meme loi", "cette loi", "le meme texte", "ce texte",
)

# Words that a search of work metadata passes over.
STOP_WORDS = (
    "and", "avec", "aux", "dans", "des", "du", "elle", "est", "et", "for", "les", "leur", "leurs", "par", "pour", "que", "qui", "sur", "the", "une", "vers",
)

#: The number of an article in a normalised query.
ARTICLE = r"(?:^|\s)(?:article|art)\s+((?:[a-z]\s+)?[0-9]+(?:(?:er)|[a-z])?(?:\s+[0-9]+)*(?:\s+(?:bis|ter|quater))?)(?:\s|$)"
#: A title with the banner of a consolidated version before it.
BANNER = r"(?i)^\s*version\s+\p{L}+\s+applicable\s+au\s+\d{2}/\d{2}/\d{4}\s*:\s*(.+)$"
#: CELEX numbers and ECLI codes, whole and within a text.
_CELEX = r"[136][0-9]{4}[A-Z][0-9]{4}|1[0-9]{4}[A-Z]/TXT"
WHOLE_IDENTIFIER = rf"(?i)^(?:(?:CELEX\s*)?({_CELEX})|(ECLI:[A-Z0-9:.]+))$"
IDENTIFIERS = rf"(?i)(?<![A-Z0-9])(?:(?:CELEX\s*)?(?:{_CELEX})|ECLI:[A-Z0-9:.]+)(?![A-Z0-9])"
_BLANK = r"[\p{Z}\x09-\x0D\x85]"


@cache
def accents() -> tuple[str, str]:
    """Letters that canonical decomposition parts into one letter and marks, and these letters.

    Hangul, which decomposes into letters, is not among them.
    """
    pairs = []
    for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0xFB50)]):
        plain = "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn")
        if plain != c and len(plain) == 1:
            pairs.append((c, plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def _plain(text: Column) -> Column:
    """Letters for letters: accents taken off, lower case; marks that stand apart stay."""
    return F.lower(F.translate(text, *accents()))


def fold(text: Column) -> Column:
    """Without accents, composed or decomposed, in lower case; ligatures stay."""
    return F.regexp_replace(_plain(text), r"\p{Mn}+", "")


def normalize(text: Column) -> Column:
    """Folded words with single spaces; a text of single letters alone closes up ("C R R" is crr)."""
    words = F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{Nd}]+", " "))
    return F.when(words.rlike(r"^\p{L}( \p{L})+$"), F.replace(words, F.lit(" "), F.lit(""))).otherwise(words)


def normalize_citation(normalized: Column) -> Column:
    """Without the word after an act's form that says that it was amended or coordinated."""
    return F.regexp_replace(normalized, rf"\b({'|'.join(QUALIFIED_FORMS)})\s+(?:{'|'.join(QUALIFIERS)})\b", "$1")


def name_forms(title: Column) -> Column:
    """A title as it stands and, if it has the banner of a consolidated version, without it."""
    bare = F.trim(F.regexp_extract(title, BANNER, 1))
    return F.when(bare != "", F.array(title, bare)).otherwise(F.array(title))


def is_act_form(normalized: Column) -> Column:
    return F.substring_index(normalized, " ", 1).isin(*ACT_FORMS)


def cites_by_date(text: Column) -> Column:
    """Whether a text names an instrument by its form and full date; it does not say which."""
    form, adjective, month = "|".join(DATED_FORMS), "|".join(ADJECTIVES), "|".join(MONTHS)
    pattern = rf"\b(?:{form})\s+(?:(?:{adjective})\s+)?(?:(?:{'|'.join(QUALIFIERS)}|amended)\s+)?(?:of|du|de|des|dated)\s+(?:the\s+)?\d{{1,2}}(?:er)?\s+(?:{month})\s+\d{{4}}\b"
    return normalize(text).rlike(pattern)


def follows_amending_clause(normalized: Column) -> Column:
    """Whether one of the last words of what stands before a mention says that it amends."""
    last = F.slice(F.reverse(F.filter(F.split(normalized, " "), lambda w: w != "")), 1, AMENDING_REACH)
    return F.arrays_overlap(last, F.array(*map(F.lit, AMENDING)))


def only_amended(normalized: Column, mention: Column) -> Column:
    """Whether a mention occurs, and everywhere right after a participle that amends."""
    here = F.concat(F.lit("(?<![^ ])"), mention, F.lit("(?![^ ])"))
    after = F.concat(F.lit(rf"(?<=(?:^| )(?:{'|'.join(AMENDING)}){'(?: [^ ]{1,64})?' * (AMENDING_REACH - 1)} )"), mention, F.lit("(?![^ ])"))
    total = F.regexp_count(normalized, here)
    # patterns of a row are compiled for it: only where a participle stands at all
    amends = normalized.rlike(rf"(?<![^ ])(?:{'|'.join(AMENDING)}) ")
    return F.when(amends, (total > 0) & (F.regexp_count(normalized, after) == total)).when(normalized.isNotNull() & mention.isNotNull(), False)


def short_titles(text: Column) -> Column:
    """Comma-separated segments, distinct and by their normalised form; none if one is not fit.

    There are at most 16 of at most 256 characters, each with a letter or digit.
    """
    parts = F.transform(F.split(text, ","), lambda s: F.trim(s))
    ok = (F.size(parts) <= 16) & F.forall(parts, lambda s: (F.length(s) <= 256) & (normalize(s) != ""))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(parts), lambda s: F.struct(normalize(s).alias("n"), s.alias("s")))), lambda x: x["s"])
    return F.when(ok, ordered).otherwise(F.array().cast("array<string>"))


def article_number(normalized: Column) -> Column:
    """The number of the article that a query names; '' if it names none."""
    return F.regexp_extract(normalized, ARTICLE, 1)


def ordinal_spellings(number: Column) -> Column:
    """Spellings of an article number: 1 is also 1er and 1re, and these are 1; 42ter is never 42."""
    base = F.regexp_extract(number, r"^([0-9]+)(?:er|re)$", 1)
    plain = F.array(number, F.concat(number, F.lit("er")), F.concat(number, F.lit("re")))
    return F.when(base != "", F.array(number, base)).when(number.rlike("^[0-9]+$"), plain).otherwise(F.array(number))


def article_key(num: Column) -> Column:
    return F.lower(F.regexp_replace(num, r"[\s.\-]+", ""))


def exact_identifiers(text: Column) -> Column:
    """CELEX numbers and ECLI codes named in a text, as written, the first of each."""
    found = F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIERS), F.lit(0)), lambda x: F.regexp_replace(x, r"^(?i)CELEX\s*", ""))
    upper = F.transform(found, F.upper)
    return F.filter(found, lambda x, i: F.array_position(upper, F.upper(x)) == i + 1)


def exact_identifier(query: Column) -> Column:
    """The CELEX number or ECLI code that a query consists of; null if it is none."""
    text = F.trim(query)
    found = F.concat(F.regexp_extract(text, WHOLE_IDENTIFIER, 1), F.regexp_extract(text, WHOLE_IDENTIFIER, 2))
    return F.when(found != "", found)


def replace_token(text: Column, source: str, target: str) -> Column:
    """A word replaced wherever it stands by itself, without regard to case."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in source)
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])", target.replace("\\", "\\\\").replace("$", "\\$"))


def tokens(text: Column) -> Column:
    """Search tokens: folded runs of letters and digits."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def _role(normalized: Column, phrases: tuple) -> Column:
    out = F.lit(None).cast("string")
    for phrase, role in reversed(phrases):
        out = F.when(F.contains(_padded(normalized), F.lit(f" {phrase} ")), role).otherwise(out)
    return out


def role_of(normalized: Column, named: Column | None = None) -> Column:
    """The role that a query speaks of, null if none; beside a ``named`` work single words tell it too."""
    role = _role(normalized, ROLES)
    return role if named is None else F.coalesce(role, F.when(named, _role(normalized, AMBIGUOUS_ROLES)))


def _without(normalized: Column, phrases) -> Column:
    out = _padded(normalized)
    for phrase in phrases:
        out = F.replace(out, F.lit(f" {phrase} "), F.lit(" "))
    return F.trim(out)


def without_article(normalized: Column) -> Column:
    number = article_number(normalized)
    cut = F.regexp_replace(normalized, F.concat(F.lit(r"(?:^|\s)(?:article|art)\s+"), number, F.lit(r"(?:\s|$)")), F.lit(" "))
    return F.when(number == "", normalized).otherwise(F.trim(cut))


def without_role(normalized: Column, role: Column) -> Column:
    """Without the phrases, longest first, that ask for the role."""
    out = normalized
    for wanted in sorted({r for _, r in ROLES}):
        phrases = sorted((p for p, r in ROLES + AMBIGUOUS_ROLES if r == wanted), key=lambda p: -len(p))
        out = F.when(role == wanted, _without(normalized, phrases)).otherwise(out)
    return out


def without_references(normalized: Column) -> Column:
    return _without(normalized, REFERENCES)


def without_conversation(normalized: Column) -> Column:
    """The words of a question that may name something."""
    return F.array_join(F.filter(F.split(normalized, " "), lambda t: (t != "") & ~t.isin(*CONVERSATIONAL)), " ")


def responsibilities_of(normalized: Column) -> Column:
    """X of "find ... provisions that describe the responsibilities of X", else the text."""
    found = F.regexp_extract(normalized, r"^find (?:(?!provisions? )[^ ]+ )*provisions? that describe (?:the )?responsibilities of (?:(?:an?|the) )?([^ ].*)$", 1)
    return F.when((found != "") & (F.size(F.split(normalized, " ")) >= 7), found).otherwise(normalized)


def residual(normalized: Column, role: Column) -> Column:
    """What is left of a query to search provisions for."""
    return without_conversation(responsibilities_of(without_references(without_role(without_article(normalized), role))))


def same_word(text: Column) -> Column:
    """Spelling that tells words of a comparison apart: quotes, dashes, blanks, the ligature and case are alike."""
    return F.lower(F.replace(F.translate(text, SAME[0], SAME[1]), F.lit("œ"), F.lit("oe")))


# Typographic characters, and those they are equal to in comparisons.
SAME = ("\u2019\u02bc\u02b9\u2013\u2014\u2212\u00a0\u202f\u2009\u201c\u201d\u00ab\u00bb", "'''---   \"\"\"\"")


def iso_date(text: Column) -> Column:
    """A strict ISO date, null if it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def snippet(text: Column, query: Column, width: int = 240) -> Column:
    """A window of a text around the first word that begins with a word of the query.

    Words of three characters or more count, without regard to accents and case.  The window
    starts a third of its width before the word and is widened to white space on either
    side; white space in it is single, and three dots stand where it was cut.  Without a
    match it is the head of the text; a blank text gives null.
    """
    terms = F.filter(F.split(normalize(query), " "), lambda t: F.length(t) >= 3)
    # letters with marks that stand apart are one with them, so that places stay those of the text
    spelled = F.transform(terms, lambda t: F.regexp_replace(t, "(.)", r"$1\\p{Mn}*"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{Nd}]\p{Mn}{0,3})(?:"), F.array_join(spelled, "|"), F.lit(")"))
    at = F.when(F.size(terms) > 0, F.regexp_instr(_plain(text), pattern)).otherwise(0)
    first = F.greatest(F.lit(0), F.greatest(at - 1, F.lit(0)) - width // 3)
    last = F.least(F.length(text), first + width)
    back = F.length(F.regexp_extract(F.substring(text, F.lit(1), first), rf"([^{_BLANK[1:-1]}]*)$", 1))
    on = F.length(F.regexp_extract(F.substring(text, last + 1, F.length(text)), rf"^([^{_BLANK[1:-1]}]*)", 1))
    start, end = first - back, last + on
    cut = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), rf"{_BLANK}+", " "))
    return F.when(cut != "", F.concat(F.when(start > 0, "... ").otherwise(""), cut, F.when(end < F.length(text), " ...").otherwise("")))


def version_coordinate(key: Column) -> Column:
    return F.substring_index(key, ":", -1)


def facet_label(value: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(value, r"[_\-]+", " ")))


def token_bucket(count: Column) -> Column:
    """The batch width that a text of so many tokens is encoded in."""
    return F.when(count <= 32, 32).when(count <= 64, 64).when(count <= 128, 128).when(count <= 256, 256).otherwise(512)


def version_key(date: Column, identifier: Column) -> Column:
    """``yyyy-mm-dd--`` and the SHA-256 of the publisher's identifier of the version."""
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("--"), F.sha2(identifier, 256))


def canonical_work(argument: Column) -> Column:
    """The slug of a work argument: ``pub:slug``, ``pub:slug:version`` or the bare slug."""
    parts = F.split(argument, ":")
    slug = F.when(F.size(parts) >= 2, parts[1]).otherwise(argument)
    return F.when(slug.rlike(r"^\d{5}[A-Za-z]{1,2}\d{4}$"), F.lower(slug)).otherwise(slug)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Folded words joined by hyphens."""
    return F.regexp_replace(F.trim(F.regexp_replace(fold(text), r"[^a-z0-9]+", " ")), " ", "-")


def text_gate(available: Column, public: Column, gate_open: bool = False) -> Column:
    """Status of a version's text: ok, text_not_available or text_withheld."""
    return F.when(~F.coalesce(available, F.lit(False)), "text_not_available").when(F.coalesce(public, F.lit(False)), "ok").otherwise("text_not_available" if gate_open else "text_withheld")


def interval_label(start: Column, end: Column, semantics: str) -> Column:
    """How an interval reads: publishers mean different things by it."""
    verb = "in force" if semantics == "publisher_applicability" else "consolidated state"
    first, last = F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
    return F.when(end.isNull(), F.concat(F.lit(f"{verb} from "), first)).otherwise(F.concat(F.lit(f"{verb} from "), first, F.lit(" to "), last))
