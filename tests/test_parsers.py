import datetime as dt
import json

from pyspark.sql import functions as F

from stratalog.functions import text as X
from stratalog.functions.timing import aligned, bucket_end, bucket_id, window_count
from stratalog.sources import latency, logs, sysinfo


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(column(F.col("v"))).collect()]


def test_sanitize(spark):
    dirty, none, plain, tabs = one(spark, X.sanitize, "\x1b[31mvol= 7\x00 ok", None, "ok", " a\t b ")
    assert dirty.text == "vol=7 ok" and dirty.changed
    assert dirty.warnings == ["ansi_removed", "nul_removed", "unicode_space_after_equals_removed", "unicode_space_normalized"]
    assert (none.text, none.warnings) == ("", ["input_was_none"]) and not plain.changed and tabs.text == "a b"


def test_log_lines(spark):
    std, blank, cont, offset, console, none = one(
        spark, logs.parse_line,
        "2024-03-01 10:00:01.250 +00:00 [Warning    ] [DiskMgr   ] [T=7,ET=] Disk 12 slow", "2024-03-01 10:00:01.250 +00:00 [Debug] [] [T=7,ET=] started", "[+] Some.Settings - found",
        "2024-03-01 12:00:01 +02:00 [Info] [X] [T=1] m", "2024-03-01 10:00:01 Gateway: queue busy", None,
    )
    assert (std.level, std.component, std.message_clean, std.ts) == ("Warning", "DiskMgr", "Disk 12 slow", dt.datetime(2024, 3, 1, 10, 0, 1, 250000))
    assert std.ctx == {"T": "7", "ET": None, "CG": None, "V": None, "S": None}
    assert blank.component == "" and cont is None and none is None and offset.ts == dt.datetime(2024, 3, 1, 10, 0, 1)
    assert (console.component, console.level, console.message_clean) == ("Gateway", "Information", "queue busy")


def test_scalars(spark):
    assert one(spark, X.parse_ms, "0.96 ms", "3MS", "x") == [0.96, 3.0, None]
    assert one(spark, X.number, "1_000", "1.5d", " 2.5 ", "1e3", "") == [None, None, 2.5, 1000.0, None]
    assert one(spark, X.safe_int, "7", " 8 ", "x") == [7, 8, None]
    assert one(spark, X.sized, "2 KB", "1.5 MB/s", "0", "9 XB") == [2048, 1572864, 0, None]
    assert one(spark, X.parse_time, "3/1/2024 10:00:00 PM", "2024-03-01T10:00:00Z", "2024-03-01 10:00:00.1234567", "no") == [dt.datetime(2024, 3, 1, 22), dt.datetime(2024, 3, 1, 10), dt.datetime(2024, 3, 1, 10, 0, 0, 123456), None]
    assert one(spark, X.context_map, "a=b=c, T = 3 ,,x")[0] == {"a": "b=c", "T": "3", "x": None, "ET": None, "CG": None, "V": None, "S": None}


def test_alignment(spark):
    at = dt.datetime(2024, 3, 1, 10, 59, 59)
    df = spark.createDataFrame([(at,)], "ts timestamp_ntz").select(aligned(F.col("ts"), 5).alias("a"), aligned(F.col("ts"), 15).alias("b"), aligned(F.col("ts"), 120).alias("c"), window_count(F.col("ts"), F.col("ts")).alias("n"))
    r = df.select("*", bucket_id(F.col("a")).alias("id"), bucket_end(F.col("a")).alias("e")).first()
    assert (r.a, r.b, r.c, r.n, r.id, r.e) == (dt.datetime(2024, 3, 1, 10, 55), dt.datetime(2024, 3, 1, 10, 45), dt.datetime(2024, 3, 1, 10), 1, "b_20240301_1055", dt.datetime(2024, 3, 1, 11))


def test_latency_layouts(spark):
    box, plain, head = one(spark, latency.parse_row, "3/1/2024 10:00:00 AM ║ 5 ║ 9.5 ║ 0 ms ║ 1.5 ms ║ 0 MB ║ 2 KB ║ 0 MB ║ 1.5 KB", "2024-03-01 10:00:00  1.5  120  10  20  1  2", "Time ║ Read")
    assert (box.write_latency_ms, box.write_io_size_bytes, box.write_throughput_bps) == (1.5, 2048, 1536)
    assert (plain.write_latency_ms, plain.read_throughput_bps, plain.write_throughput_bps) == (120.0, 1048576, 2097152) and head is None
    lines = spark.createDataFrame([("3/1/2024 10:00:00 AM ║ 5",), ("x",)], "value string")
    good, bad = latency.parse_table(lines)
    assert good.count() == 0 and bad.count() == 1


FRAME, DASHES = "=" * 44, "-" * 20
REPORT = f"""{FRAME}
[3/1/2024  8:00:00 AM] Periodic Information
{FRAME}
CPU Utilization: 12.5%
Memory   Utilization:  40%
4 HDD drives
7 HDD drives
2 SSD drives
Volumes : 9
HA State : Active (since today)
Is node leader : TRUE
Peer node status : node2, available - True
{DASHES} Network {DASHES}
eth0
 10.1.2.3
10.0.0.7
mask 255.255.0.0
{DASHES} Volumes {DASHES}
Volume v1: 3TB used
Volume v2: idle: yes
{DASHES}
10.9.9.9
5 Manual Pools:
pool1 : 4 drives. 2 volumes. 1TB / 4TB
SSD : 1 drive. 1 volume. 0.5 / 500GB
no-pool : 4 drives. 2 volumes. 1TB / 4TB
old : 0 drives. 0 volumes. 0TB / 0TB
3 degraded volumes
rebuild   occurring
{FRAME}
[3/1/2024 8:00:30 AM] Other Information
{FRAME}
CPU Utilization: 99%
Is node leader : False
"""


def test_reports(spark):
    small = f"{FRAME}\n[3/1/2024 9:00:00 PM] Periodic Information\n{FRAME}\nNo degraded volumes\nPeer node status : available - False\n"
    df = spark.createDataFrame([(REPORT + REPORT + small, "f")], "value string, source_file string")
    r, s = sorted(sysinfo.parse_reports(df).collect(), key=lambda r: r.timestamp)
    assert (r.timestamp, r.cpu_util, r.memory_util, r.disk_util) == (dt.datetime(2024, 3, 1, 8), 12.5, 40.0, 0.0)
    assert (r.hdd_count, r.ssd_count, r.total_volumes, r.ha_state, r.is_leader, r.peer_available) == (7, 2, 9, "Active", True, True)
    assert r.ip_addresses == ["10.1.2.3", "10.0.0.7"] and (r.total_pools, r.degraded_volumes, r.rebuild_active) == (5, 3, True)
    pools = {p["name"]: p for p in json.loads(r.pools_json)}
    assert list(pools) == ["pool1", "SSD", "old"] and pools["pool1"]["util_pct"] == 25.0 and pools["old"]["util_pct"] == 0.0
    assert (pools["SSD"]["used_tb"], pools["SSD"]["capacity_tb"], pools["SSD"]["drives"]) == (0.5, 0.5, 1)
    assert json.loads(r.volumes_json) == [{"id": "v1", "details": "3TB used"}, {"id": "v2", "details": "idle"}]
    assert (s.timestamp, s.cpu_util, s.ha_state, s.is_leader, s.peer_available) == (dt.datetime(2024, 3, 1, 21), 0.0, "Unknown", False, False)
    assert (s.ip_addresses, s.pools_json, s.total_pools, s.degraded_volumes, s.rebuild_active, s.source_file) == ([], "{}", 0, 0, False, "f")


def test_bracketed_lines_without_blanks_and_empty_levels(spark):
    tight, level = one(spark, logs.parse_line, "2024-03-01 10:00:01.250 +00:00[Info][Disk][T=1]m", "2024-03-01 10:00:01 [] [Disk] [T=1] a: b")
    assert (tight.level, tight.component, tight.ctx["T"], tight.message_clean) == ("Info", "Disk", "1", "m")
    assert (level.level, level.component, level.message_clean) == ("Information", "[] [Disk] [T=1] a", "b")


def test_sanitize_equals_the_steps_one_by_one(spark):
    import random
    import re

    odd, space = "\u00a0\u1680\u2000\u200b\u202f\u205f\u3000\ufeff", " \t\n\r\u2028\x1c\x85"

    def plain(raw):
        text, tags = raw, []
        for pattern, by, tag in ((r"\x1B\[[0-?]*[ -/]*[@-~]", "", "ansi_removed"), ("\x00", "", "nul_removed"), (f"=[{odd}]+", "=", "unicode_space_after_equals_removed"), (f"[{odd}]+", " ", "unicode_space_normalized")):
            after = re.sub(pattern, by, text)
            if after != text or (tag.endswith("normalized") and "unicode_space_after_equals_removed" in tags):
                tags.append(tag)
            text = after
        text = re.sub(r"[\s\x1c-\x1f\x85]+", " ", text).strip(" ")
        return text, tags, text != raw

    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "b", "=", " ", "  ", "\x1b[31m", "\x1b", "\x00", *odd, *space]) for _ in range(rnd.randrange(9))) for _ in range(500)]
    assert [(r.text, r.warnings, r.changed) for r in one(spark, X.sanitize, *texts)] == [plain(t) for t in texts]


def test_values_with_units(spark):
    assert one(spark, X.split_value_unit, "2 KB", "1.5mb/s", "0", "x", None) == [(2.0, "KB"), (1.5, "MB"), (0.0, ""), None, None]


def test_json_lines(spark):
    lines = spark.createDataFrame([('{"timestamp":"2024-03-01T10:00:00Z","cpu_util":40}',), ("{bad",), ('{"cpu_util":1}',)], "value string")
    (j,) = sysinfo.parse_json_lines(lines).collect()
    assert (j.cpu_util, j.ha_state, j.ip_addresses, j.pools_json) == (40.0, "Unknown", [], "{}")
