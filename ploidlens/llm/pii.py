"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust scores.

Base kinds, leftmost and non-overlapping for each kind: email, ip, card (Luhn), phone. They are kept
whatever their score. The method adds three kinds, kept from a score of 0.6 on: iban (mod-97), ssn
(three groups of digits with a word like "ssn" near) and secret (a long token after a word like
"token" or "api key" and = or :, to the end of its characters). Words within 48 characters before or
after a span adjust its score. An IBAN may end wherever no letter or digit follows and mod-97 holds: at its
country's length if it can, else as late as it can.

Each pattern runs in time linear in the text: an email is looked for around each @, and a run of
digits is tried from its start only, where the plain patterns give the same matches. Offsets count
code points, end exclusive. Null and empty texts: no spans. Rows are kept one by one, repeated or
not. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidlens.llm import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}((?: ?[A-Z0-9]){11,30}+))")
#: Letters and digits of an IBAN by country.
IBAN_SIZE = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"""(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key|private[_ -]?key)["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9+/_.-]{16,}+)""")
#: Score of a kind before its context, what a word of its own kind near adds, and the words.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.6}
NEAR, BONUS, MALUS, KEEP = 48, 0.25, 0.25, 0.6
CONTEXT = {
    "email": {"email", "mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment", "carte", "tarjeta", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "secret": {"token", "secret", "password", "passwd", "key", "auth", "bearer"},
}
#: Words that speak against a span near them.
AGAINST = {"version", "example", "sample", "isbn", "order", "invoice", "dummy"}
WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(t: str):
    """From each start the valid one of its country's length, or else the longest valid one."""
    done = 0
    for m in IBAN.finditer(t):
        s = m.start()
        if s < done:
            continue
        ends = [e for e in range(m.end(1), s + 14, -1) if t[e - 1] != " " and not (t[e : e + 1].isascii() and t[e : e + 1].isalnum())]
        size = {e: e - s - t.count(" ", s, e) for e in ends}
        for e in sorted(ends, key=lambda e: (size[e] != IBAN_SIZE.get(t[s : s + 2]), -e)):
            if size[e] >= 15 and mod97(t[s:e]):
                yield s, e
                done = e
                break


def _emails(t: str):
    done, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > done and t[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    t, out = text or "", []
    if "@" in t:
        out += [("email", *x) for x in _emails(t)]
    if DIGIT.search(t):
        if t.count(".") >= 3:
            out += [("ip", *m.span()) for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in t:
            out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(DIGIT.findall(m[0])) <= 15]
        out += [("iban", *x) for x in _ibans(t)]
        out += [("ssn", *m.span()) for m in SSN.finditer(t)]
    if "=" in t or ":" in t:
        out += [("secret", *m.span(1)) for m in SECRET.finditer(t) if DIGIT.search(m[1])]
    scored = []
    for kind, s, e in out:
        near = {w.lower() for w in WORDS.findall(t[max(0, s - NEAR) : s]) + WORDS.findall(t[e : e + NEAR])}
        score = min(1.0, max(0.0, PRIOR[kind] + BONUS * bool(near & CONTEXT[kind]) - MALUS * bool(near & AGAINST)))
        if kind in BASE or score >= KEEP:
            scored.append((kind, s, e, score))
    return sorted(scored, key=lambda x: (KINDS.index(x[0]), x[1]))


def redact(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    found = sorted((s, e, k) for k, s, e, _ in spans(text))
    if not found:
        return text
    out, at = [], 0
    for k, (s, e, kind) in enumerate(found):
        if s >= at or not k:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col and spans, an array of (kind, start, end, score)."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, kind)], [id_col, "spans"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(C.released(run), f"{id_col} long, spans array<struct<kind string, start long, end long, score double>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with redacted texts; the other columns, but for a column n_chars, are kept as they are."""

    @F.pandas_udf("string")
    def clean(t):
        return t.map(lambda x: redact(x) if isinstance(x, str) else None)

    docs = docs.withColumn(text_col, clean(text_col))
    return docs.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _is(kind: str):
    return lambda x: x.kind == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    listed = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(listed(lambda x: x.kind.isin(*BASE)), 256).alias("base_sha256"), listed(lambda x: F.lit(True)).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return digest(find_pii(C.documents(spark, sf_dir)))
