import base64
import bz2
import gzip
import hashlib
import random
import re
import time
import zlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from stratalog.llm import queries_free, secrets

KEY = "AKIA" + "ABCDEFGH12345678"


def plain_base(text):
    """The contract's patterns, word for word, over the whole text."""
    rules = (
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    out = [(m.start(), i, kind, m.end()) for i, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TEXTS = [
    None,
    "",
    "nothing here",
    'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b',
    "password: hunter2x PASSWD='abc' Api_Key=zzzzzz apikey : short toKen=ſecret123",
    f"é漢 {KEY} and {KEY}XYZ AKIA123",
    "ab" * 11 + "a " + "0f" * 12 + " " + "ABCDEF" * 6,
    "token=token=secret=abcdef123456",
    "secret: " + "x" * 200000 + " deadbeef" * 9,
]


def test_base_kinds_equal_the_plain_patterns():
    for text in TEXTS:
        base, _ = secrets.find_secrets(text)
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in base) == plain_base(text)


@pytest.mark.parametrize(
    "wrap, route",
    [
        (lambda s: base64.b64encode(s.encode()).decode(), "base64"),
        (lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="), "base64"),
        (lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(), "base64.gzip"),
        (lambda s: base64.b64encode(zlib.compress(s.encode())).decode(), "base64.zlib"),
        (lambda s: quote(s, safe=""), "url"),
        (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "unicode"),
        (lambda s: "".join(f"%{b:02x}" for b in base64.b64encode(base64.b64encode(s.encode()))), "url.base64.base64"),
    ],
)
def test_layers_are_unwrapped_and_mapped_to_their_outermost_run(wrap, route):
    inner = f"key {KEY} end of it"
    run = wrap(inner)
    text = f"before é {run} after"
    _, more = secrets.find_secrets(text)
    at = text.index(run)
    assert (at, at + len(run), f"access+{route}") in more
    assert KEY not in secrets.redact(text) and run not in secrets.redact(text)
    assert secrets.redact(text).startswith("before é <secret>") and secrets.redact(text).endswith(" after")


def test_clean_bombed_and_odd_texts():
    bomb = base64.b64encode(zlib.compress(b"z" * 30_000_000)).decode()
    assert secrets.find_secrets(f"x {bomb} y") == ([], [])
    clean = "Hello %%% world 100%25 sure, path/to/a_very_long_file_name_without_secret \\u00e9 " + "The quick brown fox " * 50
    assert secrets.find_secrets(clean) == ([], []) and secrets.redact(clean) == clean and secrets.redact(None) is None
    text = "token=abcdef token=abcdef"
    assert secrets.redact(text) == "<secret> <secret>"


def test_redaction_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, f"a {KEY} b", 99, "p"), (2, None, None, "q"), (2, "", 0, "q")], "doc_id long, text string, n_chars long, base string")
    out = secrets.redact_documents(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a <secret> b", 12, "p"), (2, None, None, "q"), (2, "", 0, "q")], key=str)


def test_query_digests(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("base", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries_free.op10_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = plain_base(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert all(got[i][f"n_{k}"] == len(re.findall(rf"\b{k}:", want)) for k in secrets.KINDS)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress])
@pytest.mark.parametrize("around", ["before\n{}\nafter", "data: {}", "-----BEGIN CERTIFICATE-----\n{}\n-----END CERTIFICATE-----", "long_identifier_before_it\n{}\nx"])
@pytest.mark.parametrize("width, end", [(76, "\n"), (64, "\r\n"), (64, "\n  ")])
def test_wrapped_base64_is_joined(pack, around, width, end):
    noise = " ".join(hashlib.md5(bytes([i])).hexdigest()[:9] for i in range(60))
    for size in range(3):
        run = base64.b64encode(pack(f"{noise} {KEY} {noise}{'!' * size}".encode())).decode()
        text = around.format(end.join(run[i : i + width] for i in range(0, len(run), width)))
        assert any(kind.startswith("access+base64") for _, _, kind in secrets.find_secrets(text)[1])


def test_undecodable_escapes_and_further_members_hide_nothing():
    hidden = "".join(f"%{ord(c):02x}" for c in KEY)
    for bad in ("%E9", "%FF", "%e9%20", "%C3%28", "%00%01%02%03"):
        _, more = secrets.find_secrets(f"see a={bad}&key={hidden}&b={bad} it")
        assert "access+url" in {k for _, _, k in more}, bad
    assert secrets._percents("%C3%A9%e9x%FF%41%E6%BC%A2%E6") == "é%e9x%FFA漢%E6"
    for pack in (gzip.compress, bz2.compress):
        run = base64.b64encode(pack(b"Some first member") + pack(b"middle one, ") + pack(f"key {KEY} end".encode())).decode()
        assert any(k.startswith("access+base64.") for _, _, k in secrets.find_secrets(f"x {run} y")[1])


def test_mapped_spans_leave_the_rest_of_a_run(spark):
    hidden = "".join(f"%{ord(c):02x}" for c in KEY)
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    deep = base64.b64encode(f"some words first, {KEY} and some last".encode()).decode()
    cases = {
        "a=1&name=%C3%A9%E9x&long=" + "y" * 3000 + "&token=abcdef99&z=%20": ("token=abcdef99", None),
        f'{{"name":"\\u00e9","pad":"{"p" * 500}","id":"{"0f" * 12}","n":"\\u0041"}}': ("0f" * 12, None),
        f"x=%20&k={hidden}&rest=%C3%A9": (hidden, "access+url"),
        f'{{"k":"\\u00e9{escaped}\\u00e9","rest":1}}': (escaped, "access+unicode"),
        f"q=%20&d={deep}&e=%20": (None, "access+base64"),
        "q=%20&d=" + "".join(f"%{ord(c):02x}" for c in deep) + "&e=%20": (None, "access+url.base64"),
    }
    for text, (secret, kind) in cases.items():
        base, more = secrets.find_secrets(text, mapped=True)
        assert len(base) + len(more) == 1 and (kind is None) == bool(base), (text, base, more)
        ((start, end, found),) = base + more
        assert kind in (None, found)
        if secret:
            assert text[start:end] == secret
        else:
            a = text.index("d=") + 2
            assert a < start < end < text.index("&e=") and end - start < 0.7 * (text.index("&e=") - a)
        assert secrets.redact(text, mapped=True) == text[:start] + "<secret>" + text[end:]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.text for r in secrets.redact_documents(df).collect()} == {secrets.redact(t, mapped=True) for t in cases}


@pytest.mark.parametrize("pack, route", [(zlib.compress, "zlib"), (gzip.compress, "gzip"), (bz2.compress, "bzip2"), (lambda b: gzip.compress(zlib.compress(b)), "gzip.zlib")])
def test_secrets_far_in_a_packed_body_are_found_in_windows(pack, route):
    for size in (9_000, 18_000_000):
        run = base64.b64encode(pack("é ".encode() * (size // 3) + f"key {KEY} é".encode() + "é ".encode() * 20_000)).decode()
        for window in (secrets.WINDOW, 1 << 14):
            if size < 1_000_000 or window == secrets.WINDOW:
                assert secrets.find_secrets(f"x {run} y", True, window)[1] == [(2, 2 + len(run), f"access+base64.{route}")]
    assert secrets.redact(f"x {run} y", mapped=True) == "x <secret> y"
    for at in range(16_300, 16_420, 7):
        run = base64.b64encode(pack(b"a " * (at // 2) + KEY.encode() + b" a" * 30_000)).decode()
        assert secrets.find_secrets(run, True, 1 << 14)[1] == [(0, len(run), f"access+base64.{route}")], at


def test_a_broken_body_is_read_as_far_as_it_goes_and_other_bytes_hide_nothing():
    noise = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:9] for i in range(400))
    packed = gzip.compress(f"first {KEY} {noise}".encode())
    run = base64.b64encode(packed[: len(packed) - 600]).decode()
    assert [k for _, _, k in secrets.find_secrets(run)[1]] == ["access+base64.gzip"]
    blob = bytes(range(256)) * 4
    run = base64.b64encode(blob + f"key={KEY};".encode() + blob).decode()
    ((start, end, kind),) = secrets.find_secrets(f"x {run}", mapped=True)[1]
    assert kind == "access+base64" and end - start < 40
    assert KEY.encode() in base64.b64decode(f"x {run}"[start:end])


def plain_layers(text):
    """Every percent layer, decoded step by step."""
    out = [text]
    while (after := secrets._percents(out[-1])) != out[-1]:
        out.append(after)
    return out


def test_nested_escapes_are_found_at_every_depth_and_in_time():
    hidden = "".join(f"%{'25' * (i % 4)}{ord(c):02x}" for i, c in enumerate(KEY))
    text = f"a=%25252541&b=%41{hidden}&c"
    assert KEY in plain_layers(text)[-1]
    _, more = secrets.find_secrets(text, mapped=True)
    assert (text.index(hidden), text.index(hidden) + len(hidden)) in {(a, b) for a, b, k in more if k.startswith("access+url")}
    escaped = "".join("\\" + "u005c" * (i % 3) + f"u{ord(c):04x}" for i, c in enumerate(KEY))
    _, more = secrets.find_secrets(f"x {escaped} y", mapped=True)
    assert {(a, b) for a, b, k in more if k.startswith("access+unicode")} == {(2, 2 + len(escaped))}
    for nest in ("%" + "25" * 500_000 + "41", "\\" + "u005c" * 200_000 + "u0041", "%25" * 300_000, "%" + "25" * 40_000 + hidden):
        began = time.time()
        secrets.find_secrets(nest + f" token=abcdef {KEY}", mapped=True)
        assert time.time() - began < 20, nest[:20]


def test_steps_at_once_give_the_layers_of_single_steps():
    rnd = random.Random(4)
    for _ in range(300):
        run = "".join(rnd.choice(("%", "25", "41", "%25", "%2525", "%41", "a", "%E9", "%C3%A9")) for _ in range(rnd.randrange(1, 12)))
        seen, layer = [run], run
        while True:
            shorter = secrets._shorter(layer, secrets._PERCENT_CHAIN, secrets._percent_links, secrets._percents)
            after, places = shorter or (secrets._percents(layer), None)
            if after == layer:
                break
            if places:
                assert [layer[int(a) : int(b)] for a, b in zip(places.lo, places.hi)] and "".join(layer[int(a) : int(b)] for a, b in zip(places.lo, places.hi)) == layer
            seen.append(after)
            layer = after
        every = plain_layers(run)
        assert seen[-1] == every[-1] and set(seen) <= set(every)
