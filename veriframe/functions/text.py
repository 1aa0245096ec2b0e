"""Text columns: folding, normalization, transliteration, cleaning. All run inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: letter tables and word lists -------------------------------
KAZAKH_FROM = "әғқңөұүһіı"
KAZAKH_TO = "агкноуухии"

FILLER_WORDS = [
    "university", "universities", "univ", "univer", "uni", "университет", "университета",
    "университете", "университетом", "университеты", "универ", "университети",
]

CYRILLIC_SINGLE_FROM = "абвгдезиклмнопрстуфыэ"
CYRILLIC_SINGLE_TO = "abvgdeziklmnoprstufye"
CYRILLIC_MULTI = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
CYRILLIC_SILENT = "ъь"

# "ts" goes first: in "tsh" a left-to-right reader takes "ts" before "sh".
LATIN_DIGRAPHS = [
    ("ts", "ц"), ("shch", "щ"), ("sh", "ш"), ("ch", "ч"), ("zh", "ж"), ("kh", "х"),
    ("yu", "ю"), ("ya", "я"), ("yo", "е"),
]
LATIN_MULTI = {"j": "дж", "x": "кс"}
LATIN_SINGLE_FROM = "abcdefghiklmnopqrstuvwz"
LATIN_SINGLE_TO = "абкдефгхиклмнопкрстуввз"

HTML_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

NON_PHOTO_WORDS = (
    r"logos?|coats? of arms|seals?|emblems?|maps?|plans?|diagrams?|charts?|signatures?|documents?|portraits?|"
    r"icons?|schemes?|герб\p{L}*|логотип\p{L}*|эмблем\p{L}*|карт[аыуе]|схем[аыуе]?|портрет\p{L}*|печат[ьи]|"
    r"подпис[ьи]|документ\p{L}*"
)
PEOPLE_WORDS = r"\b(people|persons|alumni|faculty members|rectors|presidents|portraits)\b|люди|выпускник"

ABBREVIATIONS = (
    "каз|англ|рус|лат|нем|фр|им|г|гг|ул|пр|просп|т|д|св|акад|проф|доц|см|ок|род|тыс|млн|млрд|напр|"
    r"e\.g|i\.e|etc|Dr|Mr|Mrs|Ms|St|Prof|Jr|Sr|Inc|Ltd|No|vs|approx|est"
)

EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
HANDLE = r"(?<=^|[\s(])@[\w.]{2,}"

WRITTEN_DATE = r"\b(1[89]\d{2}|20\d{2})-(0[1-9]|1[0-2])(?:-(0[1-9]|[12]\d|3[01]))?"
EMPTIED_BRACKETS, SPACES, SPACE_BEFORE_SIGN = r"\(\s*[,;]?\s*\)", r"\s+", r"\s+([,.;:])"


def _fold_char(char: str) -> str:
    """What one character becomes: compatibility form, lower case, Kazakh letters, then no marks."""
    lowered = unicodedata.normalize("NFKC", char).lower()
    folded = lowered.translate(str.maketrans(KAZAKH_FROM, KAZAKH_TO))
    return "".join(c for c in unicodedata.normalize("NFD", folded) if not unicodedata.category(c).startswith("M"))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for ``translate`` and a map for characters that fold to several ones.

    Built from Unicode data by rule. Hangul syllables are left composed (their parts are letters, so
    equality of folded texts does not change), and capital sigma is left to ``lower``, which knows the
    final form.
    """
    source, target, multi = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or code == 0x3A3:
            continue
        char = chr(code)
        if unicodedata.category(char) in ("Cn", "Co"):
            continue
        folded = _fold_char(char)
        if folded == char or unicodedata.category(char).startswith("M"):
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif any(unicodedata.category(c)[0] in "LN" for c in folded):
            multi[char] = folded
    return "".join(source), "".join(target), multi


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Nested text functions would otherwise copy their whole input expression at every use, and the plan grows
    exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_text(col: Column) -> Column:
    """Compatibility fold, lower case, Kazakh letters and marks dropped, everything else one space."""
    source, target, multi = _fold_tables()
    chars = "".join(multi)
    # One constant map (folded by the optimizer), read only by the rare rows that need it.
    table = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in multi.items())), F.lit("\u0001"), F.lit("\u0002"))

    def spell(plain: Column) -> Column:
        # A translate (one hash lookup per character) finds them faster than a character class would.
        return F.when(
            F.translate(plain, chars, "") != plain,
            F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""),
        ).otherwise(plain)

    def folded(text: Column) -> Column:
        wide = let(F.translate(text, source, target), lambda p: F.regexp_replace(F.lower(spell(p)), r"\p{M}+", ""))
        return F.when(text.rlike(r"[^\x00-\x7F]"), wide).otherwise(F.lower(text))

    return F.trim(F.regexp_replace(let(col, folded), r"[^\p{L}\p{N}]+", " "))


def drop_filler(folded: Column) -> Column:
    """Words of a folded text without filler words; a text of filler words only is kept whole."""
    return let(
        F.filter(F.split(folded, " "), lambda w: w != ""),
        lambda words: let(
            F.filter(words, lambda w: ~w.isin(FILLER_WORDS)),
            lambda kept: F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " "),
        ),
    )


def normalize_name(col: Column) -> Column:
    return drop_filler(fold_text(col))


def cyr_to_lat(col: Column) -> Column:
    out = F.translate(col, CYRILLIC_SINGLE_FROM + CYRILLIC_SILENT, CYRILLIC_SINGLE_TO)
    for letter, latin in CYRILLIC_MULTI.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def lat_to_cyr(col: Column) -> Column:
    out = F.regexp_replace(col, r"(?<=[aeiou])y(?![aou])", "й")
    for latin, letter in LATIN_DIGRAPHS:
        out = F.replace(out, F.lit(latin), F.lit(letter))
    for latin, letters in LATIN_MULTI.items():
        out = F.replace(out, F.lit(latin), F.lit(letters))
    return F.translate(out, LATIN_SINGLE_FROM + "y", LATIN_SINGLE_TO + "ы")


def transliterate(col: Column) -> Column:
    return let(col, lambda c: F.when(c.rlike(r"\p{IsCyrillic}"), cyr_to_lat(c)).otherwise(lat_to_cyr(c)))


def query_variants(normalized: Column) -> Column:
    """[normalized, its normalized transliteration], distinct and not empty."""
    return let(normalized, lambda n: F.filter(
        F.array_distinct(F.array(n, normalize_name(transliterate(n)))), lambda v: v != ""
    ))


def match_key(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]+", "")


def strip_html(col: Column) -> Column:
    """Tags to spaces, entities decoded once (``&amp;`` last), spaces collapsed."""
    out = F.regexp_replace(col, "<[^>]*>", " ")
    # Numeric entities: cut at each one, turn its code into the character, keep the text after it.
    pieces = lambda o: F.split(o, r"(?i)(?=&#(?:\d+|x[0-9a-f]+);)")

    def decode(piece: Column) -> Column:
        code = F.regexp_extract(piece, r"(?i)^&#(x?[0-9a-f]+);", 1)
        value = F.when(
            F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 12), 16, 10)
        ).otherwise(code).try_cast("int")
        # Guard the ampersand so that "&#38;lt;" is not decoded a second time.
        char = F.when(value == 38, F.lit("\u0001")).otherwise(code_point_char(value))
        return F.when(
            (code != "") & value.between(1, 0x10FFFF),
            F.concat(char, F.regexp_replace(piece, r"(?i)^&#x?[0-9a-f]+;", "")),
        ).otherwise(piece)

    out = let(out, lambda o: F.when(
        o.contains("&#"), F.array_join(F.transform(pieces(o), decode), "")
    ).otherwise(o))
    for name, char in HTML_NAMED.items():
        out = F.regexp_replace(out, f"(?i)&{name};", char)
    out = F.replace(F.regexp_replace(out, "(?i)&amp;", "&"), F.lit("\u0001"), F.lit("&"))
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}\x{feff}]+", " "))


def code_point_char(value: Column) -> Column:
    """Unicode character of a code point (Spark's ``char`` stops at 255): its UTF-32 bytes, decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")


def category_hint(col: Column, keywords: dict[str, str], order: list[str]) -> Column:
    """First category, in the fixed order, whose keywords occur in the text."""
    hint = F.lit(None).cast("string")
    for name in reversed(order):
        hint = F.when(col.rlike("(?iu)" + keywords[name]), F.lit(name)).otherwise(hint)
    return hint


def is_non_photo(col: Column) -> Column:
    return col.rlike(r"(?iu)(?<![\p{L}\p{N}])(?:" + NON_PHOTO_WORDS + r")(?![\p{L}\p{N}])")


def is_people(col: Column) -> Column:
    return col.rlike("(?iu)" + PEOPLE_WORDS)


def iso_date(col: Column) -> Column:
    """First date found, with the precision it was written in ("2014-06" stays a month)."""
    return F.nullif(F.regexp_extract(col, WRITTEN_DATE, 0), F.lit(""))


def clip_extract(col: Column, limit: int = 1500) -> Column:
    """Tidy text cut at the last sentence end within the limit, else with an ellipsis."""
    clean = F.regexp_replace(F.regexp_replace(col, EMPTIED_BRACKETS, ""), SPACES, " ")
    clean = F.trim(F.regexp_replace(clean, SPACE_BEFORE_SIGN, "$1"))

    def shorten(cut: Column) -> Column:
        # The text up to the last ". ", "! " or "? "; greedy, so the last one wins.
        return let(F.regexp_extract(cut, r"(?s)^(.*[.!?]) ", 1), lambda head: F.when(
            F.length(head) - 1 > limit / 3, head).otherwise(F.concat(F.rtrim(cut), F.lit("…"))))

    return let(clean, lambda c: F.when(F.length(c) <= limit, c).otherwise(let(F.substring(c, 1, limit), shorten)))


def split_sentences(col: Column) -> Column:
    """Sentences: cut after ``.!?…`` before a capital, digit, quote or bracket, not after an abbreviation."""
    marked = F.regexp_replace(
        col,
        r"(?<!(?:^|[\s(])(?:\p{Lu}|" + ABBREVIATIONS + r"))(?<![.!?…])([.!?…]+)(?=\s+[\p{Lu}\d«\"(])",
        "$1\u0002",
    )
    return F.filter(F.transform(F.split(marked, "\u0002"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))),
                    lambda s: s != "")


def lead_quote(col: Column) -> Column:
    """The first two sentences, three when two are short."""
    return let(split_sentences(col), lambda s: let(F.array_join(F.slice(s, 1, 2), " "), lambda two: F.when(
        (F.size(s) > 2) & (F.length(two) < 220), F.array_join(F.slice(s, 1, 3), " ")).otherwise(two)))


def mask_personal_data(col: Column, token: str) -> Column:
    """E-mails, then phone numbers, then handles become a placeholder."""
    out = F.regexp_replace(col, EMAIL, token)
    out = F.regexp_replace(out, PHONE, token)
    return F.regexp_replace(out, HANDLE, token)
