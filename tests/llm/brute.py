"""Plain versions of the operators, one text at a time."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from notegraph.llm import common, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


# ------------------------------------------------------------------------- pii

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_base(text):
    out = []
    for kind, pattern in _PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


_CUES = [c.replace("\x20", " ") for c in "password,passwd,passphrase,pwd,secret,token,api_key,api-key,api key,apikey,access_key,access-key,accesskey,private_key,private-key,credential".split(",")]


def iban_ok(s):
    s = s.replace(" ", "")
    return len(s) == {"DE": 22, "GB": 22}.get(s[:2], -1) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def pii_extra(text):
    """The added kinds, by trying every place of the text. Knows the IBANs of two countries only."""
    out, ends = [], dict.fromkeys(pii.EXTRA_KINDS, 0)
    low_ = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def add(kind, a, b):
        if a >= ends[kind]:
            out.append((kind, a, b))
            ends[kind] = b

    joined = lambda i: i > 0 and (text[i - 1].isalnum() or text[i - 1] in "_-")
    for m in re.finditer(r"[+0-9][+0-9 ().\-]*", text):
        if len(m[0]) >= 7:
            for x in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9]|-[0-9])", m[0]):
                a, b = m.start() + x.start(), m.start() + x.end()
                # What stands before the run is seen as well.
                if x[1] not in ("000", "666") and x[1][0] != "9" and x[2] != "00" and x[3] != "0000" and not joined(a) and not text[b : b + 1].isalnum():
                    add("national_id", a, b)
        a = m.start() - 2
        if a >= 0 and re.match("[A-Z]{2}", text[a:]) and not (a and text[a - 1].isalnum()):
            for b in range(a + 15, min(len(text), a + 50) + 1):
                if re.fullmatch("[A-Z]{2}[0-9]{2}( ?[A-Z0-9])+", text[a:b]) and iban_ok(text[a:b]) and not text[b : b + 1].isalnum():
                    add("iban", a, b)
    for i in range(len(text) + 1):  # anchors by where they end
        before, after = low_[:i], text[i:]
        if before.endswith("://") and (m := re.match(r"[A-Za-z0-9._~%!$&'*+,;=-]*:[^\s@/:]+(?=@[A-Za-z0-9])", after)):
            add("userinfo", i, i + m.end())
        for cue in ("account", "acct"):
            if before.endswith(cue) and not joined(i - len(cue)) and (m := re.match(r"(?: (?:no\.?|number|nr\.?))?[ \t]*[:#]?[ \t]*([0-9](?:[ -]?[0-9]){5,16})(?![ -]?[0-9]|[A-Za-z])", after, re.I)):
                add("account", i + m.start(1), i + m.end(1))
        for cue in _CUES:
            if before.endswith(cue) and i - len(cue) >= ends["secret"] and (m := re.match(r"(?:[_-]?(?:key|value|hash|id))?s?[\"'`]?[ \t]*(?::=|=>|==?|:)[ \t]*", after)):
                rest, at = after[m.end() :], i + m.end()
                quoted = re.match(r"([\"'`])([^\r\n]{4,}?)\1", rest)
                if quoted and quoted[1] not in quoted[2]:
                    add("secret", at + 1, at + 1 + len(quoted[2]))
                elif bare := re.match(r"[\"'`]?([^\s\"'`<>,;]{6,})", rest):
                    add("secret", at + bare.start(1), at + bare.end(1))
        if before.endswith("bearer") and i - 6 >= ends["secret"] and (m := re.match(r"[ \t]+([A-Za-z0-9._~+/-]{16,}=*)", after)) and re.search("[0-9]", m[1]):
            add("secret", i + m.start(1), i + m.end(1))
        for prefix, shape in pii._KEY_SHAPES.items():
            a = i - len(prefix)
            if a >= ends["secret"] and text[a:i] == prefix and not joined(a) and (m := re.match(shape, after)):
                add("secret", a, i + m.end())
        if before.endswith("-----begin ") and i - 11 >= ends["secret"] and (m := re.match("([A-Z0-9]+ )*?PRIVATE KEY( [A-Z]+)*-----", after)):
            close = after.find("-----END ", m.end())
            end = re.match("([A-Z0-9]+ )*?PRIVATE KEY( [A-Z]+)*-----", after[close + 9 :]) if close >= 0 else None
            body = re.match(r"(?:\s*[A-Za-z0-9+/]{16,}=*)*(?:\s*[A-Za-z0-9+/]+={1,2})?", after[m.end() :])
            add("secret", i - 11, i + (close + 9 + end.end() if end else m.end() + body.end()))
    order = {k: n for n, k in enumerate(pii.EXTRA_KINDS)}
    return sorted(out, key=lambda s: (order[s[0]], s[1]))


# --------------------------------------------------------------------- quality


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeated = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(repeated)


def quality_features(text):
    """{bucket: share} of words and of character grams, by the hashes that the operator uses."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    roller = common.Roller(0)
    prefix = roller.prefix(raw)
    out = Counter()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw.tobytes())]
    for a, b in spans:
        out[int(roller.spans(prefix, np.array([a]), np.array([b]))[0]) >> 49] += 1 / len(spans)
    n = len(raw) - 3
    for i in range(max(n, 0)):
        own = roller.prefix(raw[i : i + 4])
        out[(1 << 15) + (int(common.mix(roller.windows(own, 4) if len(own) > 4 else own)[0]) >> 49)] += 1 / n
    return out


def quality_scores(texts, y, held):
    x = np.zeros((len(texts), 1 << 16))
    for i, t in enumerate(texts):
        for k, v in quality_features(t).items():
            x[i, k] = v
    x, y, held = 30 * x, np.array(y), np.array(held)
    balance = np.where(y > 0, 0.5 / y[~held].mean(), 0.5 / (1 - y[~held].mean())) * ~held / (~held).sum()
    w, b = np.zeros(1 << 16), 0.0
    m = v = np.zeros((1 << 16) + 1)
    for t in range(1, 121):
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) * balance
        g = np.append(x.T @ err + 1e-6 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    z = x @ w + b
    slope, offset = platt(z[held], y[held])
    return 1 / (1 + np.exp(-(slope * z + offset)))


def platt(z, y):
    """Platt's slope and offset: downhill steps, halved until the loss falls."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    loss = lambda x: (np.logaddexp(0, x[0] * z + x[1]) - t * (x[0] * z + x[1])).sum() + 5e-4 * (x[0] - 1) ** 2
    x = np.array([1.0, 0.0])
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(x[0] * z + x[1], -500, 500)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (x[0] - 1), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]]), g)
        while loss(x - step) > loss(x) and np.abs(step).max() > 1e-12:
            step = step / 2
        x = x - step
    return max(x[0], 1e-3), x[1]


# --------------------------------------------------------------------- toxicity


def toxicity(rows, texts):
    """(score, passages) of texts by a model of rows(text, label, held back or not)."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    forms = lambda w: [w, *(w[:n] + "*" for n in (7, 6, 5, 4) if len(w) >= n)]
    c = {0: Counter(), 1: Counter()}
    for t, label, held in rows:
        if not held:
            c[label].update({f for w in set(words(t)) for f in forms(w)})
    n = {k: sum(v for f, v in c[k].items() if f[-1] != "*") for k in c}
    share = 0.05
    room = share * (n[0] + n[1])
    scores, mass = {}, {0: 0.0, 1: 0.0}
    kept = []
    for f in c[0].keys() | c[1].keys():
        prior = share * (c[0][f] + c[1][f])
        x = {k: c[k][f] + prior for k in c}
        odds = math.log(x[1] / (n[1] + room - x[1])) - math.log(x[0] / (n[0] + room - x[0]))
        if abs(odds / math.sqrt(1 / x[0] + 1 / x[1])) >= 2.6 and abs(odds) >= 1:
            scores[f] = odds
            if f[-1] != "*":
                kept.append((odds, x[0] / (n[0] + room)))
                for k in mass:
                    mass[k] += x[k] / (n[k] + room)
    rest = min(math.log((1 - mass[1]) / (1 - mass[0])), -1e-3)
    kept.append((rest, 1 - mass[0]))
    lo, hi = 1e-3, 64.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(p * math.exp(min(mid * s, 600)) for s, p in kept) > 1 else (mid, hi)
    lam = hi

    def segments(t):
        seen, v = Counter(), []
        for w in words(t):
            s = next((scores[f] for f in forms(w) if f in scores), 0.0)
            v.append(s / 2 ** seen[w] if s else rest)
            seen[w] += 1
        found = []

        def go(a, b):
            best = max(((sum(v[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 1e-12:
                found.append((best[0], best[2], best[3]))
                go(a, best[2])
                go(best[3], b)

        go(0, len(v))
        return sorted(found, key=lambda s: s[1]), max(len(v), 1)

    judged = [(segments(t), label) for t, label, held in rows if held]
    clean = [(m, max((s for s, _, _ in f), default=0.0)) for (f, m), label in judged if not label]
    k = len(clean) / sum(m * math.exp(-lam * top) for m, top in clean)
    evidence = lambda f, m: sum(max(0.0, lam * s - max(math.log(k * m), 0.0)) for s, _, _ in f)
    slope, offset = platt(np.array([math.log1p(evidence(*x)) for x, _ in judged]), np.array([float(label) for _, label in judged]))
    out = []
    for t in texts:
        f, m = segments(t)
        places = [x.span() for x in re.finditer(r"[^\W_]+", (t or "").lower())]
        z = slope * math.log1p(evidence(f, m)) + offset
        out.append((1 / (1 + math.exp(-z)), [(t or "").lower()[places[a][0] : places[b - 1][1]] for s, a, b in f if k * m * math.exp(-lam * s) < 0.05]))
    return out


# -------------------------------------------------------------- decontamination


def decontaminate(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for t in docs:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


# --------------------------------------------------------------------- simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(points, edges):
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in parent}


def simhash_groups(docs, radius=4):
    fps = [fingerprint(t) for _, t in docs]
    arr = np.array(fps, np.uint64)
    edges = [(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr) <= radius)]
    group = components([d for d, _ in docs], edges)
    return {d: (f"{f:016x}", group[d]) for (d, _), f in zip(docs, fps)}


# ---------------------------------------------------------------- substrings


def remove_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    roller = common.Roller(0)
    return int(roller.spans(roller.prefix(raw), np.array([0]), np.array([len(raw)]))[0])


def sentences(text, most):
    ws = [(m.start(), m[0]) for m in WORD.finditer(text)]
    whole, cur = [], []
    for i, (a, w) in enumerate(ws):
        cur.append((a, w))
        if w[-1] in ".!?" or i + 1 == len(ws) or "\n" in text[a + len(w) : ws[i + 1][0]]:
            whole.append(cur)
            cur = []
    out = []
    for s in whole:
        cuts = {0}
        if len(s) > most:
            h = [word_hash(w) >> 31 for _, w in s]
            for i in range(len(s) - most + 1):
                cuts.add(min(range(i, i + most), key=lambda j: (h[j], -j)))
        at = [*sorted(cuts), len(s)]
        out += [s[a:b] for a, b in zip(at, at[1:])]
    return out


def remove_spans(docs, least, words, most):
    """docs: (id, text). Per distinct row: sentences, removed ones, and what is left."""
    spans, units = [], {}
    for i, t in set(docs):
        # Texts of one id, or of none, come in the order of their hashes.
        name = (i is None, xxh_long(t or "", "id") if i is None else i, xxh_long(t or ""))
        u = units[i, t] = sentences(t or "", most)
        for k in range(len(u)):
            n = 0
            for j in range(k, len(u)):
                n += len(u[j])
                if n >= words and j + 1 - k >= least:
                    spans.append(((*name, k), (i, t), j + 1, tuple(w for x in u[k : j + 1] for _, w in x)))
                    break
    first = {}
    for place, _, _, x in sorted(spans, key=lambda s: s[0]):
        first.setdefault(x, place)
    gone = defaultdict(set)
    for place, row, j, x in spans:
        if first[x] != place:
            gone[row] |= set(range(place[3], j))
    out = {}
    for (i, t), u in units.items():
        text = t or ""
        edge = [x[0][0] for x in u] + [len(text)]
        cut = {c for g in gone[i, t] for c in range(edge[g], edge[g + 1])}
        kept = "".join(c for n, c in enumerate(text) if n not in cut)
        out[i, t] = (len(u), len(gone[i, t]), len(kept), sha(kept.encode()))
    return out


def xxh_long(text, *before):
    """Spark's xxhash64 of the given strings."""
    seed = 42
    for x in (*before, text):
        seed = xxhash.xxh64_intdigest(x.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


# -------------------------------------------------------------- language model


def kneser_ney(train, texts, discounts, order):
    words = lambda t: [*WORD.findall(low(t)), "\0end"]
    begin = ("\0begin",) * (order - 1)
    grams = lambda t, k: [w[i - k + 1 : i + 1] for w in [(*begin, *words(t))] for i in range(order - 1, len(w))]
    level = {order: Counter(g for t in train for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    d = {k: discounts([sum(c == i for c in level[k].values()) for i in (1, 2, 3, 4)]) for k in level}
    less = lambda k, c: d[k][min(c, 3) - 1] if c else 0
    total, lost = Counter(), Counter()
    for k, counts in level.items():
        for g, c in counts.items():
            total[g[:-1], k] += c
            lost[g[:-1], k] += less(k, c)
    c = Counter(x for t in train for x in words(t))
    n, v = sum(c.values()), len(c)

    def p(g):
        k, before = len(g), g[:-1]
        lower = p(g[1:]) if k > 1 else 1 / (v + 1)
        if not total[before, k]:
            return lower
        return (max(level[k][g] - less(k, level[k][g]), 0) + lost[before, k] * lower) / total[before, k]

    for before in [*[g[:-1] for g in level[order]][:3], ("unseen",) * (order - 1)]:
        assert abs(sum(p((*before, x)) for x in c) + p((*before, "never seen")) - 1) < 1e-9
    out = []
    for t in texts:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
        out.append((len(w), sum(c[x] > 0 for x in w), n, base, sum(math.log10(p(g)) for g in grams(t, order))))
    return out
