"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, plus signs, URL schemes,
credential cues, key prefixes and key blocks) in one pass over the text without regard
to ASCII case; a deterministic parser then expands each anchor to the boundaries of an
address, number, account or secret and validates it. No value has a greatest length.
All parsers are linear in the text, so one very long text costs what many short ones
of its size do.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` as in the base rules (leftmost,
non-overlapping per kind, failing matches dropped without retry), and beyond them
``iban`` (its country's length, checked modulo 97, with a cue or without), ``userinfo``
(credentials inside a URL), ``secret`` (a value assigned to a credential cue, quoted or
not; bearer tokens; keys with a provider's prefix; private key blocks), ``national_id``
(numbers of the form of US social security numbers) and ``account`` (account numbers
after a cue). Spans of one kind never overlap, those of different kinds may; the
earlier anchor wins within a kind, and of two that end together (a tie) the longer one.

Edge cases: a null or empty text has no spans; a null or repeated doc_id is carried as
it is, row by row; an empty table gives an empty result; other columns are ignored by
``scan_pii`` and passed through by ``redact_pii``, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "userinfo", "secret", "national_id", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[+0-9][+0-9 ().\-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]*+:[^\s@/:]++(?=@[A-Za-z0-9])")
#: After a credential cue: the rest of a name, a mark of assignment, then a quoted or a bare value.
_ASSIGNED = re.compile(r"(?:[_-]?(?:key|value|hash|id))?s?[\"'`]?[ \t]*+(?::=|=>|==?|:)[ \t]*+")
_QUOTED = {q: re.compile(rf"[^{q}\r\n]{{4,}}+(?={q})") for q in "\"'`"}
_BARE = re.compile(r"[^\s\"'`<>,;]{6,}+")
_BEARER = re.compile(r"[ \t]++((?=[A-Za-z._~+/-]*+[0-9])[A-Za-z0-9._~+/-]{16,}+=*+)")
_SOCIAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])")
_ACCOUNT_NUMBER = re.compile(r"(?: (?:no\.?|number|nr\.?))?[ \t]*+[:#]?[ \t]*+([0-9](?:[ -]?[0-9]){5,16})(?![ -]?[0-9]|[A-Za-z])", re.I)
_KEY_BLOCK = re.compile(r"(?:[A-Z0-9]++ )*?PRIVATE KEY(?: [A-Z]++)*-----")
_KEY_BODY = re.compile(r"(?:\s*+[A-Za-z0-9+/]{16,}+=*+)*+(?:\s*+[A-Za-z0-9+/]++={1,2})?")
_IBAN_RUN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")

# ---- Fixed values: what follows the prefixes of well-known providers' keys, and the lengths of IBANs.
_KEY_SHAPES = {
    "AKIA": r"[A-Z0-9]{16}(?![A-Za-z0-9])", "ASIA": r"[A-Z0-9]{16}(?![A-Za-z0-9])", "AIza": r"[A-Za-z0-9_-]{35,}+",
    "ghp_": r"[A-Za-z0-9]{36,}+", "gho_": r"[A-Za-z0-9]{36,}+", "ghu_": r"[A-Za-z0-9]{36,}+", "ghs_": r"[A-Za-z0-9]{36,}+", "ghr_": r"[A-Za-z0-9]{36,}+",
    "github_pat_": r"[A-Za-z0-9_]{22,}+", "glpat-": r"[A-Za-z0-9_-]{20,}+", "npm_": r"[A-Za-z0-9]{36,}+", "hf_": r"[A-Za-z0-9]{30,}+",
    "sk_live_": r"[A-Za-z0-9]{16,}+", "sk_test_": r"[A-Za-z0-9]{16,}+", "rk_live_": r"[A-Za-z0-9]{16,}+", "pk_live_": r"[A-Za-z0-9]{16,}+", "sk-": r"(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "xoxa-": r"[A-Za-z0-9-]{10,}+", "xoxb-": r"[A-Za-z0-9-]{10,}+", "xoxp-": r"[A-Za-z0-9-]{10,}+", "xoxr-": r"[A-Za-z0-9-]{10,}+", "xoxs-": r"[A-Za-z0-9-]{10,}+",
    "ya29.": r"[A-Za-z0-9_-]{20,}+", "eyJ": r"[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+",
}
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
# ---- End of fixed values.

_KEYS = {prefix: re.compile(shape) for prefix, shape in _KEY_SHAPES.items()}
_IBANS = {x[:2]: int(x[2:]) for x in _IBAN_LENGTHS.split()}
CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "api key", "apikey", "access_key", "access-key", "accesskey", "private_key", "private-key", "credential")
ACCOUNT_CUES = ("account", "acct")

_DIGIT, _PLUS, _AT, _SCHEME, _CUE, _BEARERS, _PREFIX, _BLOCK, _ACCOUNT = range(9)


def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, with their kind, their size and, for a key's prefix, its true form."""
    anchors = {str(d): (_DIGIT, "") for d in range(10)} | {"+": (_PLUS, ""), "@": (_AT, ""), "://": (_SCHEME, ""), "bearer": (_BEARERS, ""), "-----begin ": (_BLOCK, "")}
    anchors |= {w: (_CUE, "") for w in CUES} | {w: (_ACCOUNT, "") for w in ACCOUNT_CUES} | {p.lower(): (_PREFIX, p) for p in _KEYS}
    a = ahocorasick.Automaton()
    for anchor, (kind, form) in anchors.items():
        a.add_word(anchor, (kind, len(anchor), form))
    a.make_automaton()
    return a


def folded(text: str) -> str:
    """Lower case, place by place: the one letter whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else text.replace("\u0130", "\u0131").lower()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _iban(text: str, at: int) -> int:
    """The end of the IBAN that starts at ``at``, or 0."""
    size = _IBANS.get(text[at : at + 2])
    m = _IBAN_RUN.match(text, at) if size else None
    if not m:
        return 0
    have, end = 0, at
    while have < size and end < m.end():
        have += text[end] != " "
        end += 1
    if have < size or (end < len(text) and text[end].isalnum()):
        return 0
    s = text[at:end].replace(" ", "")
    return end if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else 0


def _numbers(text: str, lo: int, hi: int) -> Iterator[tuple[str, int, int]]:
    """Addresses, cards and phones lie inside one run of digits and joiners."""
    for m in _IP.finditer(text, lo, hi):
        if all(map(_octet, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text, lo, hi):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text, lo, hi):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def _joined(text: str, at: int) -> bool:
    """Whether what starts at ``at`` goes on from a word before it."""
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_-")


def find_spans(text: str, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    ends = dict.fromkeys(EXTRA_KINDS, 0)
    run_end = email_end = 0
    block_end = -2  # of the next private key block; -1: there is none

    def add(kind: str, start: int, end: int) -> None:
        if start >= ends[kind]:
            found.append((kind, start, end))
            ends[kind] = end

    for last, (kind, size, form) in auto.iter(folded(text)):
        at, after = last - size + 1, last + 1
        if kind in (_DIGIT, _PLUS):
            if at < run_end:
                continue
            run_end = _RUN.match(text, at).end()
            if run_end - at >= 7:
                found.extend(_numbers(text, at, run_end))
                if "-" in text[at:run_end]:
                    for m in _SOCIAL.finditer(text, at, run_end):
                        if not _joined(text, m.start()) and not text[m.end() : m.end() + 1].isalnum():
                            add("national_id", m.start(), m.end())
            if at >= 2 and text[at - 2].isupper() and not (at > 2 and text[at - 3].isalnum()) and (end := _iban(text, at - 2)):
                add("iban", at - 2, end)
        elif kind == _AT:
            lo = at
            while lo > email_end and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append(("email", lo, email_end))
        elif kind == _SCHEME:
            if after >= ends["userinfo"] and (m := _USERINFO.match(text, after)):
                add("userinfo", m.start(), m.end())
        elif kind == _ACCOUNT:
            if not _joined(text, at) and (m := _ACCOUNT_NUMBER.match(text, after)):
                add("account", m.start(1), m.end(1))
        elif at < ends["secret"]:
            continue
        elif kind == _CUE:
            if m := _ASSIGNED.match(text, after):
                quote = _QUOTED.get(text[m.end() : m.end() + 1])
                if v := (quote and quote.match(text, m.end() + 1)) or _BARE.match(text, m.end() + bool(quote)):
                    add("secret", v.start(), v.end())
        elif kind == _BEARERS:
            if m := _BEARER.match(text, after):
                add("secret", m.start(1), m.end(1))
        elif kind == _PREFIX:
            if text.startswith(form, at) and not _joined(text, at) and (m := _KEYS[form].match(text, after)):
                add("secret", at, m.end())
        elif m := _KEY_BLOCK.match(text, after):
            if block_end != -1 and block_end < m.end():
                block_end = text.find("-----END ", m.end())
            close = _KEY_BLOCK.match(text, block_end + 9) if block_end != -1 else None
            add("secret", at, close.end() if close else _KEY_BODY.match(text, m.end()).end())
    order = {k: i for i, k in enumerate(KINDS + EXTRA_KINDS)}
    found.sort(key=lambda s: (order[s[0]], s[1]))
    return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches):
    auto = automaton()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py() or "", auto)] for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array(spans, _SPANS)], names=["doc_id", "spans"])


def scan_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, spans array<struct<kind,start,end>>."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replaces each maximal union of spans by ``<KIND>`` of the span that starts first."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def _redact(batches):
    auto = automaton()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if (t := x.as_py()) is None else redact(t, find_spans(t, auto)) for x in batch.column(at)]
        cols = list(batch.columns)
        cols[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in ``text`` (and ``n_chars``, if there, brought up to date)."""
    out = docs.mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_pii``'s spans."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return scanned.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
