"""Personal data in plain and in disguised text, as spans of the text's own code points.

Plain identifiers are found by fixed patterns. Then transducers rewrite the text step by step -
homoglyphs to ASCII, spelled digits to digits, "at" and "dot" disguises to signs - and each keeps,
for every character that it writes, the span of source characters it came from. The same detectors
run on what was rewritten, and a find that touches a rewritten place is mapped back.

Defined cases: a null text counts as empty and has no spans; repeated rows are searched row by row;
other columns are ignored, and the masking operator hands them on unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outward, so that a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """(kind, start, end) of plain identifiers by start, then in the order of KINDS."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


#: Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅαοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIJSaoABEZHIKMNOPTYX"))
#: Characters that are not seen, and look-alikes of signs.
INVISIBLE = "­​‌‍⁠﻿"
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＋": "+", " ": " ", " ": " ", " ": " "}
#: Digits by name in English, German, French and Spanish.
SPELLED = {
    w: str(d)
    for names in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(names.split())
} | {"oh": "0"}
#: Spelled digits in a row before they are taken for a number.
LEAST_SPELLED = 3

_SPELLED_WORD = re.compile(r"(?<!\w)(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9]+)(?!\w)", re.IGNORECASE)
_SPELLED_HINT = re.compile(r"(?<!\w)(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")(?:[ ,.\-]{1,2}(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")(?!\w))", re.IGNORECASE)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"(?:\s?{_OPEN}\s?(?:at|arroba|arobase|@)\s?{_CLOSE}\s?)"
_DOT = rf"(?:\s?{_OPEN}\s?(?:dot|punkt|point|punto|\.)\s?{_CLOSE}\s?)"
_LABEL = r"[A-Za-z0-9-]+"
_NAME = r"[A-Za-z0-9_%+-]+"
_BARE_DOT = r"(?: dot | punkt | punto | point )"
#: Words that no host of bare words begins with, and that end none after a bare "point" (as in "at this point in").
DETERMINERS = frozenset("a an the this that these those which what each every any some one no another his her its my your our their".split())
FUNCTION_WORDS = DETERMINERS | frozenset("of in on to for from with by at as and or but so if than then when where while who he she it we you they is are was were be been has have had will would can could may might do does did not".split())
#: Words that announce an address, and hosts of mailboxes.
CUES = frozenset("mail email e-mail mailto write contact reach address schreiben schreib kontakt adresse anschrift écrire écrivez contacter contactez courriel escribir escriba escribe contacto correo dirección".split())
MAILBOXES = frozenset("gmail googlemail yahoo hotmail outlook live icloud aol gmx web proton protonmail mail posteo yandex fastmail".split())
#: Words that stand before "at" in prose.
BEFORE_AT = FUNCTION_WORDS | frozenset("look looking looked meet me us him them shop buy find found see visit live work working worked stay arrive arrived stop sold online here home only now all available sign hosted".split())
_CUE = re.compile(r"([^\W\d_-]+(?:-[^\W\d_]+)?)\W{0,3}(?:(?:to|me|us|is|at|an|an uns|à|a|ist|est|es)\W{1,3}){0,2}\Z", re.IGNORECASE)
#: A disguise must make up a whole address: name, at, label, dot, label.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<name>{_NAME}(?:(?:\.|{_DOT}|{_BARE_DOT}){_NAME}){{0,4}}?)(?P<at>{_AT}|@| at | arroba | arobase )(?P<host>{_LABEL}(?:(?:{_DOT}|{_BARE_DOT}|\.){_LABEL}){{1,5}})",
    re.IGNORECASE,
)
_DISGUISE_HINT = re.compile(rf"{_OPEN}\s?(?:at|arroba|arobase|@|dot|punkt|point|punto|\.)\s?{_CLOSE}| (?:at|arroba|arobase) [A-Za-z0-9-]+(?: dot | punkt | punto | point )|@[A-Za-z0-9-]+ (?:dot|punkt|punto|point) |[0-9] (?:dot|punkt|punto|point) [0-9]", re.IGNORECASE)
#: Digit groups of an ip, with dots or their disguises between them.
_DOTTED_DIGITS = re.compile(rf"(?<![0-9])[0-9]+(?:(?:\.|{_DOT}|{_BARE_DOT})[0-9]+){{3,}}", re.IGNORECASE)
_ANY_DOT = re.compile(rf"{_DOT}|{_BARE_DOT}", re.IGNORECASE)


class Tape:
    """A text with, for every character, the source span it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, None, None, None

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        if self.starts is None:
            return start, end, False
        return self.starts[start], self.ends[end - 1], any(self.changed[start:end])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the given spans, in order and apart from each other."""
        if not edits:
            return
        n = len(self.text)
        if self.starts is None:
            self.starts, self.ends, self.changed = array("L", range(n)), array("L", range(1, n + 1)), bytearray(n)
        text, starts, ends, changed, at, cut = [], array("L"), array("L"), bytearray(), 0, False
        for s, e, new in [*edits, (n, n, "")]:
            text.append(self.text[at:s])
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            changed += self.changed[at:s]
            if cut and s > at:  # what follows a character that was left out counts as rewritten
                changed[at - s] = 1
            cut = not new
            if new:
                text.append(new)
                starts += array("L", [self.starts[s]]) * len(new)
                ends += array("L", [self.ends[e - 1]]) * len(new)
                changed += b"\1" * len(new)
            at = e
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


def _glyph(c: str) -> str | None:
    """What a character looks like in ASCII; None if it isn't a look-alike; empty if it isn't seen."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in SIGNS:
        return SIGNS[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    wide = unicodedata.normalize("NFKC", c)
    return wide if wide != c and len(wide) == 1 and wide.isascii() and wide.isprintable() else None


_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*\Z")
_ODD = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), g) for m in _ODD.finditer(text) if (g := _glyph(m[0])) is not None]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Rows of spelled digits, parted by at most two blanks or signs, become digits without gaps."""
    out, row = [], []

    def close():
        if sum(not m[0].isdigit() for m in row) >= LEAST_SPELLED:
            if text[max(0, row[0].start() - 5) : row[0].start()].lower() == "plus ":
                out.append((row[0].start() - 5, row[0].start(), "+"))
            for i, m in enumerate(row):
                till = row[i + 1].start() if i + 1 < len(row) else m.end()
                gap = text[m.end() : till]
                digit = SPELLED.get(m[0].lower(), m[0])
                out.append((m.start(), till, digit + ("." if gap.strip() == "." else "")))

    for m in _SPELLED_WORD.finditer(text):
        if row and not re.fullmatch(r"[ ,.\-]{1,2}", text[row[-1].end() : m.start()]):
            close()
            row = []
        row.append(m)
    close()
    return out


def _announced(text: str, m: re.Match, labels: list[str]) -> bool:
    """Whether something beside the words "at" and "dot" speaks for an address.

    A name of several parts or with a digit or sign; a mailbox's host after no word of prose; a colon,
    bracket or quote before the name; or a word such as "mail" or "write to".
    """
    name = m["name"]
    if re.search(r"[0-9._%+-]", name) or _ANY_DOT.search(name):
        return True
    if name.lower() in BEFORE_AT:
        return False
    if labels[0] in MAILBOXES:
        return True
    before = text[max(0, m.start() - 40) : m.start()]
    if re.search(r"[:(<\[\"'„“«]\s?\Z", before):
        return True
    cue = _CUE.search(before)
    return cue is not None and cue[1].lower() in CUES


def _disguise_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _DISGUISED.finditer(text):
        dots = list(_ANY_DOT.finditer(m["host"]))
        marks = [m["at"], *(d[0] for d in dots), *(d[0] for d in _ANY_DOT.finditer(m["name"]))]
        if marks == ["@"] or marks[0] != "@" and marks[0].strip()[0] not in "[({<" and not dots:
            continue  # plain, or only the word "at"
        labels = re.split(r"\.|" + _ANY_DOT.pattern, m["host"].lower())
        last = labels[-1]
        bare_marks = [x for x in marks if x != "@" and x.strip()[0] not in "[({<"]
        bare = bool(bare_marks)
        if len(last) < 2 or not last.isalpha() or bare and labels[0] in DETERMINERS:
            continue
        if bare and len(bare_marks) == len(marks) and not _announced(text, m, labels):
            continue
        if any(x.lower() == " point " for x in marks) and (last in FUNCTION_WORDS or labels[0].isdigit()):
            continue
        s = m.start("name")
        out += [(s + d.start(), s + d.end(), ".") for d in _ANY_DOT.finditer(m["name"])]
        if m["at"] != "@":
            out.append((*m.span("at"), "@"))
        out += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in dots]
    return out


def _dotted_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start() + d.start(), m.start() + d.end(), ".") for m in _DOTTED_DIGITS.finditer(text) for d in _ANY_DOT.finditer(m[0])]


def search(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), both by start and then in the order of KINDS."""
    base = detect(text)
    tape = Tape(text)
    if not _PLAIN.match(text):
        tape.rewrite(_glyph_edits(tape.text))
    if _SPELLED_HINT.search(tape.text):
        tape.rewrite(_spelled_edits(tape.text))
    if _DISGUISE_HINT.search(tape.text):
        tape.rewrite(_disguise_edits(tape.text))
        tape.rewrite(_dotted_edits(tape.text))
    if tape.starts is None:
        return base, base
    more = []
    for kind, s, e in detect(tape.text):
        start, end, changed = tape.source(s, e)
        if changed and not any(k == kind and a <= start and end <= b for k, a, b in base):
            more.append((kind, start, end))
    return base, sorted({*base, *more}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each found place named by its kind; places that overlap go as one."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            base, every = search(text.as_py() or "")
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((doc, *counts, sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        if rows:
            types = [pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def find(docs: DataFrame) -> DataFrame:
    """RESULT's columns for every row of docs (doc_id, text); counts are of plain spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rows, RESULT)


def _mask(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = [None if (t := x.as_py()) is None else masked(t, search(t)[1]) for x in batch.column(i)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    return run


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every find in the text column replaced by its kind."""
    return docs.mapInArrow(_mask(text), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
