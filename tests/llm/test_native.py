import collections
import hashlib
import re
import time

from netquarry.llm import chat_format, line_dedup, quality_rules, secrets
from pyspark.sql import functions as F

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string, formatted string, at long"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(t):
    return tuple((x is not None, x) for x in t)


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], CONV)


def brute_chats(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check_chats(spark, rows):
    got = chat_format.chat_digests(chat_format.format_chats(chats(spark, rows))).collect()
    assert all(r["round_trip"] for r in got)
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == brute_chats(rows)


def test_chat_round_trip(spark):
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"),
        (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
        (1, 0, "user", "a &amp; b &lt;/s> &#91;"),
        (1, 1, "assistant", "[INST"),
        (1, 2, "assistant", "</s"),
        (1, 2, "assistant", "</s"),
        (2, None, None, None),
        (2, None, "assistant", "&amp;amp;"),
        (None, 3, "[/INST]", "x" * 100000),
        (3, 0, "assistant", "\U0001f600" * 50 + "&"),
    ]
    check_chats(spark, rows)
    spans = chat_format.format_chats(chats(spark, rows)).where("conv_id = 3").first()
    (a, b) = spans["loss_spans"][0]
    assert chat_format.OPEN not in spans["formatted"][a:b] and spans["formatted"][a:b] == "\U0001f600" * 50 + "&"
    hostile = chat_format.format_chats(chats(spark, rows)).where("conv_id = -7").first()["formatted"]
    assert hostile.count("</s>") == 2 and hostile.count("[INST]") == 2
    assert chat_format.format_chats(chats(spark, [])).count() == 0


def test_chat_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_chats(spark, rows)


def brute_line_rows(rows):
    """The text that is left of each row: the first of each window stays, by (doc_id, hash of the text, row, position)."""
    digest = lambda t: -1 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    seen, gone = set(), collections.defaultdict(set)
    for r in sorted(range(len(rows)), key=lambda r: (*key((rows[r][0],)), digest(rows[r][1]), r)):
        t = rows[r][1]
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)] if t is not None else []
        for k in range(len(lines) - 2):
            w = tuple(x for _, x in lines[k : k + 3])
            if w in seen:
                gone[r] |= {i for i, _ in lines[k : k + 3]}
            seen.add(w)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[r]) for r, (_, t) in enumerate(rows)]


def brute_lines(rows):
    return {d: t for (d, _), t in zip(rows, brute_line_rows(rows), strict=True)}


def check_lines(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = [(d, t) for (d, _), t in zip(rows, brute_line_rows(rows), strict=True)]
    got = line_dedup.dedup_lines(docs)
    # Equal rows are interchangeable: the multiset of what is left must agree.
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["text"])) for r in got.select("doc_id", "text").collect())
    return got


def test_line_dedup(spark, sf_dir):
    docs = fixtures.awkward(spark)
    assert check_lines(docs).columns == [*docs.columns, *line_dedup.ADDED]
    assert line_dedup.dedup_lines(fixtures.empty(spark)).count() == 0
    got = check_lines(documents(spark, sf_dir))
    assert got.where("_changed").count() > 0


def test_line_dedup_of_repeated_rows(spark):
    """Repeated rows, texts that share an id, null ids, and columns named like those of the result."""
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", None, "p\nq\nr\ns"]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[4]), (None, texts[4]), (None, None), (3, texts[4])]
    docs = spark.createDataFrame([(i, t, 1, 2, "n", True) for i, t in rows], "doc_id long, text string, n_lines long, removed_lines long, changed string, _changed boolean")
    got = check_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "removed_lines", "changed", *line_dedup.ADDED]


def test_line_dedup_of_many_repeats_of_one_row(spark, monkeypatch):
    """Beyond what counts as hot: one row of a key stays as it is, in whichever task it lies."""
    from netquarry.llm import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    rows = [(None, "a\nb\nc\nd")] * 150 + [(7, "a\nb\nc\nd\ne")] * 40 + [(k, f"x{k}\ny\nz") for k in range(30)]
    check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def brute_metrics(text):
    words = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def check_rules(docs):
    got = quality_rules.quality_rules(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    norm = lambda t: [re.sub("[0-9]", "0", x.lower()).strip(" ") for x in (t or "").split("\n") if WORD.search(x)]
    texts = collections.defaultdict(set)
    for r in rows:
        for x in norm(r["text"]):
            texts[r["source"], x].add(r["text"])
    frequent = lambda r, x: len(texts[r["source"], x]) > quality_rules.MOST_TEXTS
    want = []
    for r in rows:
        m = brute_metrics(r["text"])
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        cut = [x for x in norm(r["text"]) if frequent(r, x)]
        depleted = sum(map(len, cut)) * 100 > sum(map(len, norm(r["text"]))) * quality_rules.DEPLETED_PERCENT
        want.append((r["doc_id"], *m, failed, not failed and not depleted, len(cut)))
    assert sorted((tuple(r)[:9] for r in got), key=key) == sorted(want, key=key)
    clean = lambda r: r["text"] and "\n".join(x for x in r["text"].split("\n") if not (WORD.search(x) and frequent(r, norm(x)[0])))
    cleaned = quality_rules.cleaned_documents(docs)
    assert cleaned.columns == [*docs.columns, "kept"]
    assert sorted((tuple(r) for r in cleaned.select("doc_id", "text", "kept").collect()), key=key) == sorted(((r["doc_id"], clean(r), w[7]) for r, w in zip(rows, want, strict=True)), key=key)
    return got


def test_quality_rules(spark, sf_dir):
    check_rules(fixtures.awkward(spark))
    assert sum(r["removed_lines"] for r in check_rules(documents(spark, sf_dir))) > 0
    assert sum(r["removed_lines"] for r in check_rules(documents(spark, "/root/testdata/sf0.01"))) > 200
    assert quality_rules.quality_rules(fixtures.empty(spark)).count() == 0


def test_quality_rules_boilerplate(spark):
    rows = [(i, f"the very same banner line of this host with many words in it\nown {i}", "en", "h", 1, "x", 7, "r") for i in range(60)]
    # Copies of one text are one document.
    rows += [(200 + i, "a banner that stands in one text only, copied a number of times over", "en", "h", 1, "x", 7, "r") for i in range(20)]
    rows += [(100 + i, " ".join(f"w{chr(97 + i)}x{k}" for k in range(30)), "en", "h", 1, "x", 7, "r") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, fixtures.DOC_SCHEMA)).collect()}
    assert not any(got[i] for i in range(60)) and all(got[100 + i] and got[200 + i] for i in range(20))


KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = {
    "assign": (re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def brute_entropy(x):
    """Scaled like the operator: the largest of window * log2(window) - sum n log2 n."""
    best = 0
    for i in range(len(x) - secrets.WINDOW + 1):
        counts = collections.Counter(x[i : i + secrets.WINDOW])
        best = max(best, round(secrets.WINDOW * 4.321928094887363 * secrets._SCALE) - sum(secrets._NLOGN[n] for n in counts.values()))
    return best


def brute_random(x):
    pairs = [p.lower() for p in map("".join, zip(x, x[1:])) if re.fullmatch("[A-Za-z]{2}", p)]
    return len(pairs) >= secrets.LEAST_PAIRS and sum(p in secrets.PLAUSIBLE for p in pairs) * 100 < len(pairs) * secrets.WORDS_PERCENT


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), i, m.end()) for i, (p, ok) in enumerate(BASE.values()) for m in p.finditer(text) if ok(m)]
    extra = []
    for m in re.finditer(secrets.CANDIDATE, text):
        x = m[0]
        if any(a < m.end() and m.start() < b for a, _, b in spans) or not re.search("[A-Za-z]", x) or re.search(secrets.ALLOWED, x):
            continue
        digit = re.search("[0-9]", x)
        if not (brute_random(x) or (digit and not re.search(secrets.NAME, x))):
            continue
        least = secrets.HEX_BITS if digit and re.fullmatch("[0-9a-fA-F]+", x) else secrets.LETTER_BITS if not digit else secrets.BASE64_BITS if re.search("[+/_-]", x) else secrets.MIXED_BITS
        if brute_entropy(x) >= round(least * secrets.WINDOW * secrets._SCALE):
            extra.append((m.start(), 3, m.end()))
    say = lambda s: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
    return (*[sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(say(spans).encode()).hexdigest(), say(spans + extra))


def check_secrets(docs):
    got = secrets.secret_digests(secrets.scan_secrets(docs)).collect()
    want = [(r["doc_id"], *brute_secrets(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    return got


def test_secrets(spark, sf_dir):
    got = check_secrets(fixtures.awkward(spark))
    assert any("entropy" in r["spans"] for r in got)
    got = check_secrets(documents(spark, "/root/testdata/sf0.01"))
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) > 0
    assert secrets.scan_secrets(fixtures.empty(spark)).count() == 0


def test_window_entropy(spark):
    rows = ["a1" * 10, "abcdefghij0123456789", "q7" + "Zk3Pw9Lm2Xc8Vb5Nt1Rs6Hd4" * 9]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", secrets.window_entropy(F.col("x")).alias("e")).collect()
    assert [r["e"] for r in got] == [brute_entropy(r["x"]) for r in got]


def test_secrets_in_a_text_full_of_matches(spark):
    """Many matches of one text take time in proportion; so does holding candidates against base spans."""
    text = "\n".join(f"token = abcdefgh{i} and q7Zk3Pw9Lm2Xc8Vb5Nt1Rs{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = secrets.secret_digests(secrets.scan_secrets(docs)).first()
    assert time.time() - began < 60
    assert tuple(got)[:6] == (1, *brute_secrets(text)) and got["n_assign"] == 20_000 and got["n_entropy"] == 20_000


def test_secrets_spare_paths_and_names(spark):
    clean = ["/2024/05/17/how-to-build-a-fast-index", "my_project_module_2_final_version_name", "org/docs/v2/getting-started-with-spark-sql", "src/main/java/GettingStartedWithQueries2", "0123456789abcdefghij0123456789", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    found = ["q7Zk3Pw9Lm2Xc8Vb5Nt1Rs6", "aB3/xY9+Qm2Lk7Pz0Wv4Tn8Rc1", "Zk3Pw9example7Lm2Xc8Vb5Nt1", "8f14e45fceea167a5a36dedd4bea2543"[:31]]
    rows = [(i, f"see {x} here") for i, x in enumerate([*clean, *found])]
    got = {r["doc_id"]: r["n_entropy"] for r in secrets.secret_digests(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got[i] for i in range(len(rows))] == [0] * len(clean) + [1] * len(found)


CLEAN = """src/main/java/com/acme/Util5/parseHTTPResponseV2 getUserById2FromHTTPServerV3Response7 2024-05-17T12-30-45Z_run7_log1a
node_modules/react-dom/cjs/react-dom-server /usr/local/lib/python3/site-packages/requests AbstractSingletonProxyFactoryBean2
docs/2023/11/02/release-notes-v1 TestCaseForUserAuthenticationHandler internationalization_of_currencies
http_response_status_code_404_not_found LongDescriptionOfTheProductInEnglish Donaudampfschifffahrtsgesellschaft
backup_2021-03-04_05-06-07_final /var/log/nginx/access_log_2024_01 MAX_NUMBER_OF_CONNECTIONS_PER_HOST
customer-support-ticket-4411-resolved XMLHttpRequestEventTargetV2 getElementsByClassNameAndTagName""".split()


def test_secrets_recall_and_precision(spark):
    """Random tokens of several kinds are found; paths, names, times and long words are not."""
    import string

    rng = __import__("random").Random(5)
    draw = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    low, mixed, base62 = string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits
    kinds = {
        "base62": lambda: draw(32, base62),
        "base32": lambda: draw(32, string.ascii_uppercase + "234567"),
        "base64": lambda: draw(40, base62 + "+/"),
        "hex": lambda: draw(31, "0123456789abcdef"),
        "dashed": lambda: "-".join(draw(5, string.ascii_uppercase + string.digits) for _ in range(5)),
        "letters and digits": lambda: draw(20, low) + draw(4, string.digits),
        "mixed letters": lambda: draw(40, mixed),
        "small letters": lambda: draw(40, low),
    }
    rows = [(k, f"see {make()} here") for k, make in kinds.items() for _ in range(300)] + [("clean", f"see {x} here") for x in CLEAN]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_entropy"] for r in secrets.secret_digests(secrets.scan_secrets(docs)).collect()}
    share = {k: sum(got[i] > 0 for i, r in enumerate(rows) if r[0] == k) / sum(r[0] == k for r in rows) for k in [*kinds, "clean"]}
    print(share)
    assert share["clean"] == 0 and all(share[k] >= 0.93 for k in kinds), share


def test_chat_of_many_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>" if i % 7 == 0 else f"turn {i}") for i in range(20_000)]
    check_chats(spark, rows)
    got = chat_format.format_chats(chats(spark, rows[:50])).first()
    assert [got["formatted"][a:b] for a, b in got["loss_spans"]] == [chat_format_escaped(x) for _, _, r, x in rows[:50] if r == "assistant"]


def chat_format_escaped(x):
    return x.replace("&", "&amp;").replace("[", "&#91;").replace("<", "&lt;") if "</s>" in x else x
