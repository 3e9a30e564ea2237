"""Personal data: regular expressions propose spans, checksums confirm them, nearby words set the score.

Base kinds are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. The method
adds IBANs (mod 97), US social-security numbers and secrets such as access tokens and passwords; a
proposal's form gives a score, a context word nearby adds to it, and it is kept if that reaches ``MIN_SCORE``: an IBAN
of its country's length, or a secret of letters and digits, needs no such word, others do. Patterns are scanned in time linear in the text:
an e-mail's local part is sought to the left of each ``@``, number patterns start only at a run's start.

Defined results: null text is empty and has no spans; texts of any length are scanned whole; spans are
half-open code-point ranges, ordered by start and then kind; spans of different kinds may overlap, of
one kind never; an empty table gives an empty result; repeated rows and extra columns pass through.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
#: Least score of an added span; characters on either side in which a context word counts.
MIN_SCORE = 0.6
CONTEXT = 40

# The contract's patterns, with starts held to a run's start where that finds the same.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s*+[=:]\s*+[\"']?([A-Za-z0-9+/_.-]{8,}+)")
#: Lengths of IBANs by country.
_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_WORDS = {"iban": re.compile(r"(?i)iban|bank|account|konto|compte|cuenta"), "ssn": re.compile(r"(?i)\bssn\b|social|security|tax"), "secret": re.compile(r"(?i)\b(?:login|user(?:name)?|credentials?|bearer|private|auth\w*)\b")}


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks has remainder 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _ibans(text: str):
    """Spans of IBANs. A proposal may have swallowed the words after one: it is cut at a blank where the rest is an
    IBAN, at its country's length if it can be, and what is left is scanned again."""
    m = _IBAN.search(text)
    while m:
        ends = [m.end(), *(k for k in range(m.end() - 1, m.start(), -1) if text[k] == " ")]
        sizes = {k: len(text[m.start() : k].replace(" ", "")) for k in ends}
        ends = sorted((k for k in ends if k == m.end() or sizes[k] >= 15), key=lambda k: (sizes[k] != _LENGTHS.get(m[0][:2]), -k))
        end = next((k for k in ends if mod97(text[m.start() : k].replace(" ", ""))), None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 4)


def _scored(kind: str, text: str, start: int, end: int, base: float) -> bool:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return base + (0.3 if _WORDS[kind].search(near) else 0.0) >= MIN_SCORE


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data in ``text``, in order."""
    found: list[tuple[int, int, int]] = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                    found.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((*m.span(), 3))
        found += [(a, b, 4) for a, b in _ibans(text) if _scored("iban", text, a, b, 0.4 + 0.3 * (len(text[a:b].replace(" ", "")) == _LENGTHS.get(text[a : a + 2])))]
        if "-" in text:
            found += [(*m.span(), 5) for m in _SSN.finditer(text) if _scored("ssn", text, *m.span(), 0.3)]
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            mixed = bool(re.search(r"[0-9]", m[2])) + bool(re.search(r"[A-Za-z]", m[2]))
            if _scored("secret", text, *m.span(), 0.3 * mixed + 0.02 * min(len(m[2]), 10)):
                found.append((*m.span(2), 6))
    found.sort(key=lambda s: (s[0], s[2], s[1]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each stretch that spans cover replaced by its first span's kind, as ``<KIND>``."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def spans_column(text: Column) -> Column:
    """All spans of each text as array<struct<start, end, kind>>."""

    @F.arrow_udf("array<struct<start:int,end:int,kind:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in find_spans(t.as_py())] for t in texts], kind)

    return spans(F.coalesce(text, F.lit("")))


def span_digests(text: Column) -> Column:
    """struct of the count of each base kind, the SHA-256 of the base spans' list, and the list of all spans."""

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def digests(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            spans = find_spans(t.as_py())
            base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE)
            counts = {f"n_{kind}": sum(k == kind for _, _, k in spans) for kind in BASE}
            rows.append(counts | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(f"{k}:{a}:{b}" for a, b, k in spans)})
        return pa.array(rows, pa.struct([*((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return digests(F.coalesce(text, F.lit("")))


def redacted_column(text: Column) -> Column:
    """The text with its spans replaced; null stays null."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([None if (s := t.as_py()) is None else redact(s, find_spans(s)) for t in texts], pa.string())

    return redacted(text)


def redact_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its texts redacted; all other columns pass through."""
    return df.withColumn(text_col, redacted_column(F.col(text_col)))
