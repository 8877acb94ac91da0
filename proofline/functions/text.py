"""Scalar text expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import constants as K


HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(maxsize=None)
def _rewritten(form: str) -> dict[str, str]:
    """What a normal form makes of each letter, without combining marks for NFKD: only letters that change.

    Built from the Unicode tables. Hangul syllables stay whole; they would fall into letters without losing any mark.
    """
    out = {}
    for code in range(0x80, sys.maxunicode + 1):
        if code in HANGUL or 0xD800 <= code < 0xE000:
            continue
        plain = plain_letters(chr(code)) if form == "NFKD" else unicodedata.normalize(form, chr(code))
        if plain != chr(code):
            out[chr(code)] = plain
    return out


def plain_letters(word: str) -> str:
    """NFKD of a word without combining marks; Hangul syllables stay whole."""
    parts = (c if ord(c) in HANGUL else unicodedata.normalize("NFKD", c) for c in word)
    return "".join(c for part in parts for c in part if not unicodedata.combining(c))


@lru_cache(maxsize=None)
def _translation(form: str) -> tuple[str, str]:
    """(characters, replacements) of letters rewritten to one letter, then of those that go, as `translate` takes them."""
    single = {c: p for c, p in _rewritten(form).items() if len(p) == 1}
    gone = [c for c, p in _rewritten(form).items() if not p]
    return "".join([*single, *gone]), "".join(single.values())


def _spread(text: Column, form: str) -> Column:
    """The text with every letter that becomes several written out; texts without one are left alone."""
    several = {c: p for c, p in _rewritten(form).items() if len(p) > 1}
    letters = "".join(several)
    width = max(map(len, several.values()))
    # the k-th letters of all replacements, the letters with longer ones first: what is beyond a table's end goes
    tables = []
    for k in range(width):
        long_enough = [c for c, p in several.items() if len(p) > k]
        rest = [c for c, p in several.items() if len(p) <= k]
        tables.append(("".join([*long_enough, *rest]), "".join(several[c][k] for c in long_enough)))
    codes = sorted(map(ord, several))
    ranges, begin = [], codes[0]
    for code, following in zip(codes, [*codes[1:], None], strict=True):
        if following != code + 1:
            ranges.append(f"\\x{{{begin:x}}}-\\x{{{code:x}}}")
            begin = following
    written = F.transform(F.split(text, ""), lambda c: F.when(
        F.lit(letters).contains(c) & (c != ""), F.concat(*[F.translate(c, source, target) for source, target in tables])
    ).otherwise(c))
    # the class is a chain of some hundred ranges, which plain letters need not walk through
    return F.when(text.rlike(rf"[\x{{80}}-\x{{10FFFF}}&&[{''.join(ranges)}]]"), F.array_join(written, "")).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def fold_text(text: Column, underscores: bool = False) -> Column:
    """Lower case in compatible plain letters without accents (NFKD less its marks); with `underscores`, `_` becomes a space."""
    source, target = _translation("NFKD")
    # plain texts are most of all, and need no table
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(_spread(text, "NFKD"), source, target)).otherwise(text)
    folded = F.lower(plain)
    return F.replace(folded, F.lit("_"), F.lit(" ")) if underscores else folded


@lru_cache(maxsize=None)
def _mark_classes() -> dict[str, int]:
    """The combining class of each letter that has one."""
    return {chr(c): k for c in range(0x300, sys.maxunicode + 1) if (k := unicodedata.combining(chr(c)))}


@lru_cache(maxsize=None)
def _pairs() -> dict[str, str]:
    """Each two letters that stand for one letter, from the Unicode tables; Hangul, which follows a rule, is not among them."""
    out = {}
    for code in range(0xC0, sys.maxunicode + 1):
        letter = chr(code)
        if code in HANGUL or 0xD800 <= code < 0xE000 or unicodedata.normalize("NFC", letter) != letter:
            continue
        parts = unicodedata.decomposition(letter).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out["".join(chr(int(p, 16)) for p in parts)] = letter
    return out


def _looked_up(table: dict[str, object], kind: str) -> Column:
    """A literal map, built as one text so that the plan stays small. Its letters are no separators."""
    return F.expr(f"str_to_map({_sql_text(chr(1).join(k + chr(2) + str(v) for k, v in table.items()))}, '\\u0001', '\\u0002')").cast(f"map<string,{kind}>")


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _composed(text: Column) -> Column:
    """Letters and the marks behind them as one letter where there is one; marks in canonical order first."""
    classes, pairs = _looked_up(_mark_classes(), "int"), _looked_up(_pairs(), "string")
    letters = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), F.coalesce(F.try_element_at(classes, c), F.lit(0)).alias("k")))
    # a mark belongs to the last letter before it that is none; marks of one letter go by class, equal ones stay in order
    starters = F.aggregate(
        letters,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<n:int,k:int,i:int,c:string>>").alias("out")),
        lambda held, x: let(held["n"] + F.when(x["k"] == 0, 1).otherwise(0), lambda n: F.struct(
            n.alias("n"), F.array_append(held["out"], F.struct(n.alias("n"), x["k"].alias("k"), F.size(held["out"]).alias("i"), x["c"].alias("c"))).alias("out")
        )),
    )["out"]

    def step(held: Column, x: Column) -> Column:
        # `last` is the class of the mark that stands between the letter and this one, -1 where nothing does
        free = (held["last"] < x["k"]) & ((x["k"] > 0) | (held["last"] < 0))
        return let(F.when(free & (held["letter"] != ""), F.try_element_at(pairs, F.concat(held["letter"], x["c"]))), lambda one: F.when(
            one.isNotNull(), F.struct(held["done"].alias("done"), one.alias("letter"), held["marks"].alias("marks"), held["last"].alias("last"))
        ).when(x["k"] > 0, F.struct(
            held["done"].alias("done"), held["letter"].alias("letter"), F.concat(held["marks"], x["c"]).alias("marks"), x["k"].alias("last")
        )).otherwise(F.struct(
            F.concat(held["done"], held["letter"], held["marks"]).alias("done"), x["c"].alias("letter"), F.lit("").alias("marks"), F.lit(-1).alias("last")
        )))

    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("letter"), F.lit("").alias("marks"), F.lit(-1).alias("last"))
    return F.aggregate(F.array_sort(starters), begin, step, lambda held: F.concat(held["done"], held["letter"], held["marks"]))


def compat_text(text: Column) -> Column:
    """NFKC: full-width letters, ligatures, hard spaces and the like in their plain form, letters and marks composed.

    Hangul letters stay apart. Plain texts, which are most of all, need no table.
    """
    def rewritten(part: Column, form: str) -> Column:
        source, target = _translation(form)
        return F.translate(_spread(part, form), source, target)

    marked = let(rewritten(text, "NFKC"), lambda w: F.when(w.rlike(r"\p{M}"), _composed(rewritten(w, "NFD"))).otherwise(w))
    return F.when(text.rlike(r"[^\x00-\x7F]"), marked).otherwise(text)


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def present(value: Column) -> Column:
    """Neither null nor the empty string."""
    return F.coalesce(value != "", F.lit(False))


def non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def phone_key(phone: Column) -> Column:
    """8 to 15 digits once separators are dropped; null otherwise, and for any `@` address."""
    digits = F.regexp_replace(phone, r"[\s+().-]", "")
    return F.when(~phone.contains("@") & digits.rlike(r"^\d{8,15}$"), digits)


def digits_key(phone: Column) -> Column:
    """All digits of a phone; null when none is left or for an `@` address."""
    digits = F.regexp_replace(phone, r"\D", "")
    return F.when(~phone.contains("@"), non_empty(digits))


def chat_address(sender: Column) -> Column:
    """The sender when it is a full chat address."""
    return F.when(sender.rlike(r"^\d+@(c\.us|lid)$"), sender)


def recipient(sender: Column, phone: Column, agent_phone: Column | None = None) -> Column:
    """Chat address of a sender, or one made from the phone: the sender's, and only if that is missing the agent's."""
    called = phone if agent_phone is None else F.coalesce(non_empty(phone), agent_phone)
    return F.coalesce(chat_address(sender), F.concat(phone_key(called), F.lit("@c.us")))


def business_key(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def extension(path: Column) -> Column:
    """Last suffix of a path, lower case, with its dot; null when there is none."""
    return F.lower(non_empty(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)))


def media_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*K.VIDEO_EXTENSIONS), "video").when(ext.isin(*K.IMAGE_EXTENSIONS), "image")


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date").cast("string")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def notification_panel(text: Column) -> Column:
    """True for the text of a phone's own notification panel.

    Three groups of words must all be met: a recorder or a silent list, a
    connectivity tile, and a panel control.
    """
    def judged(folded: Column) -> Column:
        def has(words: Sequence[str]) -> Column:
            return reduce(lambda a, b: a | b, [folded.contains(w) for w in words])

        silent, erase = K.PANEL_SILENT
        recorder = has(K.PANEL_RECORDER) | (folded.contains(silent) & folded.contains(erase))
        return recorder & has(K.PANEL_TILES) & has(K.PANEL_CONTROLS)

    return F.coalesce(let(fold_text(text), judged), F.lit(False))


def suggested_message(
    name: Column, app: Column, group: Column, day: Column, reason: Column, ref: Column
) -> Column:
    """Reminder text for one case, with a placeholder for whatever is unknown."""
    return F.concat(
        F.lit("Bonjour "), F.coalesce(name, F.lit("")),
        F.lit(", votre rapport ("), F.coalesce(non_empty(app), F.lit(K.APPLICATION_TO_STATE)),
        F.lit(" / "), F.coalesce(non_empty(group), F.lit(K.GROUP_TO_STATE)),
        F.lit(" / "), F.coalesce(non_empty(day), F.lit(K.DATE_TO_STATE)),
        F.lit(") est à refaire. Motif : "), reason,
        F.lit(f". {K.RECORDING_INSTRUCTIONS} {K.ANSWER_IN_GROUP} {K.PRIVATE_CHAT_NOTICE} Référence de suivi : "),
        ref.cast("string"), F.lit("."),
    )


def append_history(history: Column, entry: Column) -> Column:
    """The history array with one more entry; a missing history starts empty."""
    return F.when(history.isNull(), F.array(entry)).otherwise(F.array_append(history, entry))


def safe_cell(value: Column) -> Column:
    """Text that a spreadsheet will not run as a formula; null becomes empty."""
    return F.when(value.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(
        F.coalesce(value, F.lit(""))
    )
