"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate them.

Anchors are at-signs, plus signs, digits, ``://`` and cue words. From an anchor a parser expands left and
right over the characters that its kind allows, and checks what it has found. Parsers skip anchors inside what they
have consumed or have already found to fail, or look at a bounded number of characters, so that a text takes linear
time. Each gives what a leftmost, non-overlapping search would give.

Kinds, in their order: email, ip (parts up to 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits);
the method adds login (scheme://user@host), secret (cue, then 16 or more characters with letters and digits)
and account (IBAN after its cue, by its country's length and its check digits; other cues with 6 to 17 digits).

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; rows are handled
one by one, so repeated rows give repeated rows; extra columns aren't read by :func:`find` and kept by
:func:`redact`, whatever they are called.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import ready, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "account")
# Cue words before identifiers, in any case; those of accounts begin a word.
SECRET_CUES = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey")
ACCOUNT_CUES = ("iban", "account", "konto", "cuenta", "compte", "ssn")

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"://[A-Za-z0-9._~%!$&'*+,;=-]{1,256}(?::[^\s@/]{0,256})?@[A-Za-z0-9.-]++")
SECRET = re.compile(r"[\"']?[ \t]{0,4}(?:=|:|[iI][sS])[ \t]{0,4}[\"']?([A-Za-z0-9_+/-]{16,}+)")
ACCOUNT = re.compile(r"(?: (?i:no|nr|number)\b\.?)?[ \t]{0,4}[:#=]?[ \t]{0,4}((?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,16})(?![A-Za-z0-9]))")

# Characters of an IBAN by country.
IBAN = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in string.digits:
        found.add_word(c, ("digit", 1))
    for word, kind in (("@", "email"), ("+", "phone"), ("://", "login")):
        found.add_word(word, (kind, len(word)))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) << (n & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def account_end(text: str, m: re.Match) -> int | None:
    """Where the account number that ``m`` begins with ends; None if it is no account number.

    Words in upper case after an IBAN look like its parts. So it ends at its country's length, or else at the last
    end of a word where its check digits hold.
    """
    start, last = m.span(1)
    if text[start].isdecimal():
        return last
    ends, length = [], 0
    for at in range(start, last):
        length += text[at] != " "
        if length >= 15 and text[at] != " " and (at + 1 == last or text[at + 1] == " "):
            ends.append((length, at + 1))
    usual = IBAN.get(text[start : start + 2])
    for _, end in sorted(ends, key=lambda x: (x[0] == usual, x[0]), reverse=True):
        if iban(text[start:end]):
            return end
    return None


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all personal data of a text, sorted."""
    if not text:
        return []
    found = []
    done = dict.fromkeys((*KINDS, "digit", "no secret"), 0)
    low = text.lower()
    if len(low) != len(text):  # the one letter whose lower case is two characters
        low = text.replace("\u0130", "i").lower()
    for last, (anchor, length) in automaton().iter(low):
        at = last - length + 1
        if anchor == "digit":
            if at >= done["ip"]:
                m = IP.match(text, at)
                done["ip"] = (m or DIGITS.match(text, at)).end()
                if m and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                    found.append((at, 1, m.end()))
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    found.append((at, 2, m.end()))
        elif anchor == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found.append((start, 0, m.end()))
        elif anchor == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif anchor == "login":
            start = at
            while start > max(done["login"], at - 16) and text[start - 1] in SCHEME:
                start -= 1
            if start < at and (m := LOGIN.match(text, at)):
                done["login"] = m.end()
                found.append((start, 4, m.end()))
        elif anchor == "secret":
            # A run of characters that fails as a secret fails from any cue inside it, too.
            if last >= done["secret"] and last + 3 >= done["no secret"] and (m := SECRET.match(text, last + 1)):
                if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
                    done["secret"] = m.end()
                    found.append((m.start(1), 5, m.end()))
                else:
                    done["no secret"] = m.end()
        elif last >= done["account"] and not (at and text[at - 1].isalpha()) and (m := ACCOUNT.match(text, last + 1)) and (end := account_end(text, m)):
            done["account"] = end
            found.append((m.start(1), 6, end))
    found.sort()
    return found


def replaced(text: str | None) -> str | None:
    """The text with [KIND] in place of each span; of overlapping ones the first, then the longest, names it."""
    if not text or not (found := spans(text)):
        return text
    out, end, at = [], 0, 0
    merged: list[list[int]] = []
    for start, kind, stop in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], stop)
        else:
            merged.append([start, kind, stop])
    for at, kind, stop in merged:
        out += [text[end:at], f"[{KINDS[kind].upper()}]"]
        end = stop
    return "".join([*out, text[end:]])


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "spans") -> DataFrame:
    """The columns ``keep`` and the spans of ``text``: array of (kind, start, end), by start, then kind."""
    ready(df.sparkSession)

    def run(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(x)] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, SPAN)], names=[*keep, into])

    kept = df.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    return kept.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in kept.dtypes[1:]], f"`{into}` array<struct<kind: string, start: bigint, end: bigint>>"]))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with personal data in ``text`` replaced by its kind."""
    ready(df.sparkSession)
    at, names = df.columns.index(text), df.columns

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([replaced(x) for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))


def _of(found: str, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(_of("spans", *BASE)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
