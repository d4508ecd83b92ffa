"""URL verdicts, drifted files and conversations against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from notegraph.llm import common, conversations, queries, schema_drift, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


# ------------------------------------------------------------------------ urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    found = [(len(h + p), h + p, said) for said, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[1:] if found else (None, None)


def plain_urls(rows):
    """page_id -> (host, path, rule, verdict) by the same model, counted in dictionaries."""
    mask = lambda s: re.sub("[0-9]+", "#", s)
    letters = r"[^\W\d_]+"
    urls = {(mask(h), mask(p)) for h, p in (plain_parts(u) for _, u, _ in rows)}
    counts = Counter(url_filter.SEEDS)
    for name in {n for h, p in urls for n in re.split(r"[^\w#-]+", f"{h}/{p}".lower())}:
        runs = re.findall(rf"{letters}|[#_-]+", name)
        if len(runs) > 1:
            counts.update(r for r in runs if r[0] not in "#_-")
    for _, _, html in rows:
        counts.update(w for w in re.split(r"[\W\d_]+", re.sub("<[^>]*>", " ", html or "").lower()))
    counts = {w: n for w, n in counts.items() if 1 <= len(w) <= url_filter.LONGEST_WORD}
    total = sum(counts.values())
    shares, unknown = {w: math.log(n / total) for w, n in counts.items()}, math.log(10 / total)

    def split(run):
        if run == "#" or len(run) > url_filter.LONGEST_RUN:
            return (run,)
        best = [(0.0, ())]
        for end in range(1, len(run) + 1):
            best.append(max(((best[b][0] + shares.get(run[b:end], unknown - (end - b) * math.log(10)), (*best[b][1], run[b:end])) for b in range(end - 1, -1, -1)), key=lambda x: round(x[0], 9)))
        return best[-1][1]

    words = {u: [w for r in re.findall(rf"{letters}|#", f"{u[0]}/{u[1]}".lower()) for w in split(r)] for u in urls}
    bad = {u for u, ws in words.items() if set(ws) & set(url_filter.SEEDS)}
    uses = (Counter(w for u in bad for w in words[u]), Counter(w for u in urls - bad for w in words[u]))
    n = [sum(x.values()) for x in uses]
    prior, s = math.log((len(bad) + 1) / (len(urls) - len(bad) + 1)), url_filter.SMOOTHING

    def odds(w):
        share = s * (uses[0][w] + uses[1][w]) / max(1, sum(n))
        return math.log((uses[0][w] + share) / (n[0] + s)) - math.log((uses[1][w] + share) / (n[1] + s))

    out = {}
    for page_id, url, _ in rows:
        host, path = plain_parts(url)
        rule, said = plain_rule(host, path)
        score = prior + sum(map(odds, words[mask(host), mask(path)]))
        out[page_id] = (host, path, rule, said or ("block" if score > 0 else "allow"), round(score, 6))
    return out


URLS = [
    (1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "HTTP://WWW.Casino-Win.example.NET"), (6, "https://org/x?y"), (7, "https://sub.org/"), (8, "https://notorg/"), (9, "https://a.example.org/es/1"),
    (10, "https://a.example.org/en/17#x"), (11, "https://a.example.org/en/27"), (12, "x://a.b?q=://"), (13, "http://cheapcasinobets.example.net/poker/best-odds"), (14, "http://quietgarden.example.net/plants/roses"),
    (15, "http://h/" + "verylong" * 3000), (16, "http://" + "a" * 70 + ".net/" + "x1" * 4), (17, "http://Ünïcode.example.net/straße\nnext"), (18, "http://quietgarden.example.net/plants/roses"), (18, "http://quietgarden.example.net/plants/roses"),
    (None, "http://xxx-porn.example.net/a_b-c"), (20, "http://com/fr/"), (21, "http://x.com/de/?a"),
]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"u1": F.lit(1), "run": F.lit("x"), "words": F.lit("y"), "host": F.lit("z"), "shape": F.lit(0)})
    return url_filter.judge(df, queries.URL_RULES, texts=df.select("html"))


def test_urls_against_a_plain_model(spark):
    html = ["<p>cheap casino bets in a quiet garden</p><b>best odds", None, "", "<a href='casino'>plants and roses</a> quiet garden " * 50]
    rows = [(i, u, html[k % 4]) for k, (i, u) in enumerate(URLS)]
    out = judged(spark, rows)
    got = sorted(((r.page_id or 0), r.host, r.path, str(r.rule), r.verdict, round(r.block_odds, 6)) for r in out.collect())
    want = plain_urls(rows)
    assert got == sorted(((i or 0), *(str(x) if k == 2 else x for k, x in enumerate(want[i]))) for i, _, _ in rows)
    assert want[5][3] == "block" and want[13][3] == "block" and want[14][3] == "allow"
    assert {"u1", "run", "words", "shape", "html"} <= set(out.columns)


def test_urls_of_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    want = plain_urls(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, round(r.block_odds, 6)) for r in queries.queries()["op11_url_filters"](spark, SF).collect()}
    assert got == want


def test_urls_empty(spark):
    assert judged(spark, []).collect() == []


def test_splits_are_the_best():
    rng = random.Random(3)
    shares = {w: math.log(rng.random()) for w in ("a", "ab", "ba", "bab", "aab", "b")}
    unknown = -3.0

    def all_splits(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in all_splits(s[i:])]

    value = lambda ws: sum(shares.get(w, unknown - len(w) * math.log(10)) for w in ws)
    for _ in range(100):
        run = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        got = url_filter.best_split(run, shares, unknown)
        assert "".join(got) == run and math.isclose(value(got), max(map(value, all_splits(run))))


# ------------------------------------------------------------------------ files

NAMES = schema_drift.NAMES


def crc(i):
    return zlib.crc32(str("" if i is None else i).encode())


def plain_files(rows):
    """What the contract asks of clients' files, from sorted rows."""
    rows = sorted(rows, key=lambda r: (crc(r[0]), r[0] is not None, r[0] or 0))
    per = 1 + len(rows) // 500
    out = {}
    for number in range(-(-len(rows) // per)):
        v = schema_drift.version_of(number)
        names = list(NAMES)
        if v & 4:
            names = [n for n in names if n not in ("nation_id", "source")]
        if v & 1:
            names = [{"name": "email", "email": "name"}.get(n, n) for n in names]
        if v & 2:
            names = names[:1] + names[:0:-1]
        final = []
        for r in rows[number * per : (number + 1) * per]:
            r = dict(zip(NAMES, r, strict=True))
            if v & 4:
                r |= {"nation_id": -1, "source": "none"}
            if v & 8 and r["balance"] is not None:
                r["balance"] = pa.scalar(r["balance"], pa.float64()).cast(pa.float32(), safe=False).as_py()
            if r["updated_at"] is not None:
                since = r["updated_at"].replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
                r["updated_at"] = (since.days * 86400 + since.seconds) * 10**6 + since.microseconds
            if r["balance"] is not None:
                r["balance"] = math.floor(1048576 * r["balance"]) if math.isfinite(r["balance"]) else str(r["balance"])
            final.append(["?" if x is None else str(x) for x in r.values()])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[number] = (v, len(final), sum(r.count("?") for r in final), sha(",".join(r[0] for r in final)), sha("\n".join("|".join(r) for r in final)), ",".join(names), ",".join(NAMES), v > 0)
    return out


def files_of(df):
    return {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in df.collect()}


def test_files_of_clients(spark):
    want = plain_files([tuple(r) for r in spark.read.parquet(f"{SF}/clients.parquet").select(*NAMES).collect()])
    df = queries.queries()["op12_schema_drift"](spark, SF)
    assert files_of(df) == want and {v[0] for v in want.values()} > {0, 1, 2, 4, 8}
    paths = [r.path for r in df.collect()]
    folder = paths[0].removeprefix("file://").rpartition("/")[0]
    held, at = pyarrow.fs.LocalFileSystem(), pyarrow.fs.FileSelector(folder, recursive=True)
    assert sorted(f.path for f in held.get_file_info(at)) == sorted(p.removeprefix("file://") for p in paths)
    for p in paths[:40]:
        schema = pq.read_schema(p.removeprefix("file://"))
        assert schema_drift.ids(schema) == list(range(1, 11)) and str(schema.field("nation_id").type) == "int64" and str(schema.field("balance").type) == "double"


def test_files_of_odd_rows(spark):
    when = datetime(1969, 12, 31, 23, 59, 59, 5)
    rows = [(i, i, "crm", when, "n", "e", "c", 3, "s", i / 3) for i in range(20)] + [(None,) * 10, (-5, None, "", None, "é" * 50_000, "a|b\nc", None, None, "!", -0.5), (100, 1, "x", when, None, None, None, 2, None, float("nan")), (101, 1, "x", when, None, None, None, 2, None, float("-inf"))]
    rows += [rows[3]] * 3 + [(102, 9, "y", when, "", "", "", 1, "", 1e300)]
    df = spark.createDataFrame(rows, "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double")
    df = df.withColumns({"file_no": F.lit(7), "_row": F.lit("x"), "_h": F.lit(1)})
    assert files_of(schema_drift.rewrite_clients(df)) == plain_files(rows)
    assert schema_drift.rewrite_clients(df.limit(0)).collect() == []


EVOLVED = schema_drift.clients_schema(pa.timestamp("us"))


def migrated(tmp_path, bits, table=None):
    fs, path = pyarrow.fs.LocalFileSystem(), str(tmp_path / f"f{bits}.parquet")
    schema = schema_drift.drifted(EVOLVED, bits, swap=(5, 6), gone=(8, 3), narrow={8: pa.int32(), 10: pa.float32()})
    start = table or pa.table([pa.array([None] * 3, f.type) for f in schema], schema=schema)
    pq.write_table(start, path)
    done = schema_drift.migrate(fs, path, str(tmp_path / "stage"), EVOLVED, schema_drift.DEFAULTS)
    return fs, path, schema, done


@pytest.mark.parametrize("bits", range(16))
def test_every_drift_is_seen_in_the_footer(tmp_path, bits):
    fs, path, schema, done = migrated(tmp_path, bits)
    assert done == (bits, schema.names)
    after = pq.read_table(path)
    assert after.schema.equals(EVOLVED) and schema_drift.ids(after.schema) == schema_drift.ids(EVOLVED) and after.num_rows == 3
    assert after.column("source").null_count == (0 if bits & 4 else 3) and not list((tmp_path / "stage").glob("*")) if bits else True
    # a task that runs again reports the same and writes nothing
    before = (tmp_path / f"f{bits}.parquet").stat().st_mtime_ns
    assert schema_drift.migrate(fs, path, str(tmp_path / "stage"), EVOLVED, schema_drift.DEFAULTS) == done
    assert (tmp_path / f"f{bits}.parquet").stat().st_mtime_ns == before


def test_columns_without_known_ids_do_not_pass(tmp_path):
    fields = [schema_drift.field(1, "client_id", pa.int64()), pa.field("name", pa.string()), schema_drift.field(77, "city", pa.string()), schema_drift.field(5, "who", pa.string())]
    table = pa.table([pa.array([1, 2]), pa.array(["x", "y"]), pa.array(["p", "q"]), pa.array(["a", None])], schema=pa.schema(fields))
    _, path, _, (bits, _) = migrated(tmp_path, 0, table)
    got = pq.read_table(path)
    assert bits == 7 and got.column_names == NAMES and got.column("name").to_pylist() == ["a", None] and got.column("city").to_pylist() == [None, None] and got.column("nation_id").to_pylist() == [-1, -1]
    with pytest.raises(ValueError, match="repeat"):
        schema_drift.ids(pa.schema([schema_drift.field(1, "a", pa.int64()), schema_drift.field(1, "b", pa.int64())]))


def test_hot_keys_are_numbered_apart(spark):
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("v"))
    got = schema_drift.numbered(df, [F.col("k")]).orderBy("_row").collect()
    assert [r._row for r in got] == list(range(3000)) and [r.k for r in got] == sorted(r.k for r in got)


# ---------------------------------------------------------------- conversations

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain_repair(rows):
    """Of one conversation, by whole audit strings of every state; all that cost up to nine more than the least are kept."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), signed(xxhash.xxh64_intdigest(r[3].encode(), seed=42))))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    after, turn, start = {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "su", "s": "u", "u": "a", "a": "u"}
    paths = {("", 0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        found = set()
        for state, cost, audit, lines in paths:
            for run in range(3):
                found.add((state, cost + 3, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    full = {"u": "user", "a": "assistant"}[turn[state]]
                    found.add((after[state], cost + 2 + extra, audit + "R", (*lines, f"{full}:{text}")))
                    if role[:1] and role[:1] in start[state]:
                        found.add((role[:1], cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                lines, audit, cost, state = (*lines, {"u": "user:", "a": "assistant:"}[turn[state]]), audit + "I", cost + 2, after[state]
                if run == 2:
                    break
        least = min(x[1] for x in found)
        paths = {x for x in found if x[1] <= least + 7}
        kept = {}
        for x in sorted(paths, key=lambda x: (x[1], x[2])):
            kept.setdefault(x[0], x)
        paths = set(kept.values())
    ends = []
    for state, cost, audit, lines in paths:
        for _ in range(3):
            if state in ("", "a"):
                ends.append((cost, audit, lines))
            lines, audit, cost, state = (*lines, {"u": "user:", "a": "assistant:"}[turn[state]]), audit + "I", cost + 2, after[state]
    cost, audit, lines = min(ends)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_conversations(original, damaged):
    of = defaultdict(list)
    for r in damaged:
        of[r[0]].append(r)
    return {c: plain_repair(of[c]) for c in {r[0] for r in original}}


def digest_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_conversations_of_the_table(spark):
    original = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digest_of(queries.queries()["op13_conversations"](spark, SF)) == plain_conversations(original, plain_damage(original))


def odd_turns(seed):
    rng = random.Random(seed)
    rows = [(1, 0, None, None), (2, None, "user", "a."), (2, None, "assistant", "b."), (3, 5, "", "x."), (3, 2**62, "system", "y!"), (3, -(2**62), "tool", "y!"), (None, 1, "user", "no id?"), (None, 2, "assistant", None), (4, 1, "user", " \t\n"), (5, 1, "system", "only.")]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((conv, turn + rng.randint(0, 1), role, rng.choice(["Yes.", "No", "Oh!", "é?\u2028", "", None, "long " * 3000 + "."])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_conversations(spark, monkeypatch, seed):
    monkeypatch.setattr(conversations, "PIECE_BITS", 1)  # pieces of two rows
    rows = odd_turns(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "id": F.lit(1), "kind": F.lit(0)})
    damaged = conversations.damaged(df)
    assert sorted(map(str, damaged.collect())) == sorted(str(r) for r in spark.createDataFrame(plain_damage(rows), damaged.schema).collect())
    # what is damaged, and rows as they are, which tie and lack ids
    for given, plain in ((damaged, plain_damage(rows)), (df, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])):
        done = conversations.repair(given)
        want = plain_conversations(rows, plain)
        assert digest_of(conversations.digest(df, done)) == want
        lines = defaultdict(list)
        for r in conversations.repaired(done).orderBy("pos", "nth").collect():
            lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digest(df, conversations.repair(df)).collect() == []


def test_a_conversation_of_many_pieces(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"row {rng.randint(0, 9000)}{rng.choice(['.', '.', ''])}") for i in range(9000)]
    rows += [(2, 0, "user", "same.")] * 3000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = digest_of(conversations.digest(df, conversations.repair(df)))
    assert got == plain_conversations(rows, rows) and got[2][6] == "D" * 2999 + "KI" or got[2][6].count("D") == 2999


def test_layers_stay_few():
    rng = random.Random(4)
    conversations.step.cache_clear()
    for _ in range(50):
        conversations.summary("".join(rng.choice("suaoSUAOx") for _ in range(400)))
    assert conversations.step.cache_info().currsize < 20_000


def test_best_audit_among_all():
    """Every audit of short conversations, cut into pieces anyhow."""
    rng = random.Random(7)
    for _ in range(200):
        kinds = "".join(rng.choice("suaoSUAOxua") for _ in range(rng.randint(1, 5)))
        cut = rng.randint(0, len(kinds))
        parts = [p for p in (kinds[:cut], kinds[cut:]) if p]
        spans, tail, cost = conversations.choose([conversations.summary(p) for p in parts])
        audit = "".join(code for i, (p, (b, e)) in enumerate(zip(parts, spans, strict=True)) for code, _ in conversations.retrace(p, b, e, tail if i == len(parts) - 1 else ""))
        paths = {(conversations.START, 0, "")}
        for kind in kinds:
            new = set()
            for state, c, a in paths:
                for run in range(4):
                    new.add((state, c + 3, a + "D"))
                    if kind != "x":
                        new.add((conversations.AFTER[state], c + 2 + kind.isupper(), a + "R"))
                        if kind.lower() in conversations.LEGAL[state]:
                            new.add((conversations.LEGAL[state][kind.lower()], c + kind.isupper(), a + "K"))
                    state, c, a = conversations.AFTER[state], c + 2, a + "I"
            paths = {x for x in new if x[1] <= min(n[1] for n in new) + 9}
        ends = [(c, a) for state, c, a in paths if state in (0, 3)] + [(c + 2, a + "I") for state, c, a in paths if state == 2] + [(c + 4, a + "II") for state, c, a in paths if state == 1]
        assert (cost, audit) == min(ends)
