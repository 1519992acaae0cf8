"""Registered queries of byte patterns: every signature with packets that it finds and packets that it just doesn't, and many
patterns at once.

Of the frames of a kind, one in every group of events is a hit and one a near miss; the twins say which by the event's number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import detect, objects, search, signatures
from netloom.plans.frames import EVENTS
from netloom.plans.packets import SQL, packets

SHORT = ("no", "signature", "severity")


def _hex(data: bytes) -> str:
    return data.hex().upper()


_BODY = bytes(54)
#: Signature, severity, and twice (protocol, source port, destination port, text, bytes): a hit and a near miss.
EXPLOITS = [
    ("EternalBlue", "CRIT", ("SMB", 50000, 445, "", b"to SMBr it"), ("SMB", 50000, 446, "", b"to SMBr it")),
    ("BlueKeep (CVE-2019-0708)", "CRIT", ("RDP", 50000, 3389, "", b"\x03\x00\x00" + b"\x11" * 98), ("RDP", 50000, 3389, "", b"\x03\x00\x00" + b"\x11" * 97)),
    ("Log4Shell (CVE-2021-44228)", "CRIT", ("HTTP", 50000, 9000, "", b"a ${JnDi:ldap://x"), ("HTTP", 50000, 9000, "", b"a ${jndi;ldap://x")),
    ("Shellcode NOP sled", "HIGH", ("TCP", 50000, 4444, "", b"\x90" * 16), ("TCP", 50000, 4444, "", b"\x90" * 15)),
    ("LLMNR Poisoning", "MED", ("UDP", 50000, 5355, "", b"q" * 20), ("TCP", 50000, 5355, "", b"q" * 20)),
    ("NBNS WPAD Poisoning", "MED", ("NBNS", 50000, 137, "", b"\x00\x20\x43\x4b"), ("NBNS", 50000, 137, "", b"\x00\x20\x43\x4c")),
    ("Directory Traversal", "HIGH", ("HTTP", 50000, 80, "", b"../" * 5 + b"etc"), ("HTTP", 50000, 80, "", b"../" * 4 + b"etc")),
    ("SQL Injection Probe", "HIGH", ("HTTP", 50000, 3000, "", b"id=1' OR 1=1--"), ("HTTP", 50000, 3001, "", b"id=1' OR 1=1--")),
    ("XSS Probe", "MED", ("HTTP", 50000, 8000, "", b"<SCRIPT>a()</SCRIPT>"), ("HTTP", 50000, 8000, "", b"<script src=x>")),
    ("Heartbleed (CVE-2014-0160)", "CRIT", ("TLS", 443, 50000, "", b"\x18\x03\x02\x00\x48\x01\x00"), ("TLS", 443, 50000, "", b"\x18\x03\x02\x00\x47\x01\x00")),
    ("PrintNightmare (CVE-2021-1675)", "CRIT", ("SMB", 50000, 135, "", b"\x1c\x00SpoolSS"), ("SMB", 50000, 135, "", b"\x1c\x01SpoolSS")),
    ("Pass-the-Hash (suspected)", "HIGH", ("SMB", 50000, 445, "", b"an NTLMSSP one"), ("SMB", 50000, 445, "Kerberos", b"an NTLMSSP one")),
    ("Log4Shell via DNS (CVE-2021-44228)", "CRIT", ("DNS", 53, 50000, "query JNDI back", b"q" * 20), ("UDP", 54, 50000, "query jndi back", b"q" * 20)),
]
EXPOSURES = [
    ("Cleartext HTTP Sensitive Path", "HIGH", ("HTTP", 50000, 80, "", _BODY + b"GET /LOGIN HTTP/1.1"), ("HTTP", 50000, 80, "", b"/login" + _BODY)),
    ("Weak TLS 1.0", "HIGH", ("TLS", 50000, 443, "", b"\x16\x03\x01\x00\x05"), ("TLS", 50000, 443, "", b"\x16\x03\x02\x00\x05")),
    ("Weak SSL 3.0", "HIGH", ("TLS", 443, 50000, "", b"\x16\x03\x00\x00\x05"), ("TLS", 444, 50000, "", b"\x16\x03\x00\x00\x05")),
    ("Cleartext Telnet Credential", "HIGH", ("TCP", 23, 50000, "", _BODY + b"Password:"), ("TCP", 23, 50000, "", _BODY + b"password")),
    ("Anonymous FTP Login", "HIGH", ("FTP", 50000, 21, "", _BODY + b"USER Anonymous\r\n"), ("FTP", 50000, 22, "", _BODY + b"USER anonymous\r\n")),
    ("SMB Null Session", "HIGH", ("SMB", 50000, 445, "", b"ntlmssp" + bytes(8)), ("SMB", 50000, 445, "", b"ntlmssp" + bytes(7) + b"\x01")),
]


#: Log-ins by service: a refused one and one that isn't, or isn't told as such.
LOGINS = [
    ("SSH", "", ("SSH", 50000, 22, "", b"SSH-2.0"), ("SSH", 22, 50000, "", b"SSH-2.0")),
    ("FTP", "", ("FTP", 21, 50000, "", _BODY + b"530 Login incorrect.\r\n"), ("FTP", 21, 50001, "", _BODY + b"230 Logged in.\r\n")),
    ("FTP", "", ("FTP", 50000, 21, "", _BODY + b"530 Failed"), ("FTP", 50000, 21, "", b"530 Failed" + _BODY)),
    ("HTTP", "", ("HTTP", 50000, 443, "HTTP/1.1 401 no", b"x"), ("HTTP", 50000, 8443, "HTTP/1.1 401 no", b"x")),
    ("SMB", "", ("SMB", 50000, 445, "", b"NTLMSSP"), ("SMB", 50000, 445, "", b"ntlm ssp")),
    ("", "", ("FTP", 21, 443, "", _BODY + b"530 Failed"), ("FTP", 20, 50002, "", _BODY + b"530 Failed")),
]


def _frames(kinds: list) -> str:
    """Packets of all kinds in turn: hit, miss, hit of the next, and so on."""
    each = [form for _, _, *forms in kinds for form in forms]
    pick = lambda values: "CASE " + " ".join(f"WHEN n % {len(each)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"
    text = lambda place: pick("'" + e[place] + "'" for e in each)
    data = f"unhex({pick(chr(39) + _hex(e[4]) + chr(39) for e in each)})"
    return f"""SELECT n + 1 AS no, t AS timestamp, concat('198.51.100.', CAST(u AS STRING)) AS src, '10.0.0.5' AS dst, {text(0)} AS protocol, CAST({pick(e[1] for e in each)} AS INT) AS src_port,
      CAST({pick(e[2] for e in each)} AS INT) AS dst_port, CAST(NULL AS INT) AS vlan_id, {text(3)} AS info, CAST(octet_length({data}) AS INT) AS length, {data} AS bytes FROM {EVENTS} f0"""


def _found(kinds: list) -> str:
    rows = ", ".join(f"({2 * i}, '{name}', '{severity}')" for i, (name, severity, *_) in enumerate(kinds))
    return f"SELECT event_id + 1 AS no, signature, severity FROM events JOIN (VALUES {rows}) v(k, signature, severity) ON event_id % {2 * len(kinds)} = k"


def _over(sql: str, operator):
    return lambda spark, sf_dir: operator(spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))).select(*SHORT)


#: Words of the benchmark's passages, of six letters or more, are the patterns of an item's rule; every other item asks for all of them.
def _word_hits(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)))).alias("w"))
    rules = words.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("rule"), F.col("w").alias("pattern"), F.lit("literal").alias("kind"), F.col("w").alias("text"), F.lit(False).alias("nocase"),
        F.when(F.col("item_id") % 2 == 0, "any").otherwise("all").alias("condition"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    hits = objects.pattern_hits(docs, objects.rules_of(rules), "doc_id", most=1 << 30)
    return hits.groupBy("rule", "pattern").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("documents"), F.min("offset").alias("first_offset"))


NEEDLES = ["10.0.1.7", "SSH", "click", "nothing has this", "supplier#00000001", "1003"]


def _searches(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("label"), F.col("s_nationkey").cast("string").alias("detail"), F.lit("").alias("hay"), F.col("s_suppkey").alias("place"))
    return search.searches({"Packet": search.packet_finds(packets(spark, sf_dir)), "Supplier": suppliers}, NEEDLES)


def _logins(spark, sf_dir):
    return detect.auth_burst(spark.sql(_frames(LOGINS), events=spark.read.parquet(f"{sf_dir}/events.parquet")), 3, 5.0).select("no", "signature", "detail")


def queries() -> dict:
    return {
        "d_bf_services": _logins,
        "d40_d52_exploits": _over(_frames(EXPLOITS), signatures.exploits),
        "d_vuln_exposures": _over(_frames(EXPOSURES), signatures.exposures),
        "r6_many_patterns": _word_hits,
        "f18_searches": _searches,
    }


def _login_sql() -> str:
    """The third log-in of a source, service and target within five seconds, the first time that this happens."""
    rows = ", ".join(f"({2 * i}, '{name}', {hit[2]})" for i, (name, _, hit, _) in enumerate(LOGINS) if name)
    return f"""WITH l AS (SELECT event_id + 1 AS no, CAST(event_id AS DOUBLE) / 40 AS t, concat('198.51.100.', user_id % 6 + 1) AS src, service, port FROM events JOIN (VALUES {rows}) v(k, service, port) ON event_id % {2 * len(LOGINS)} = k),
        m AS (SELECT *, count(*) OVER (PARTITION BY src, port ORDER BY t RANGE BETWEEN 5.0::DOUBLE PRECEDING AND CURRENT ROW) AS hits FROM l),
        f AS (SELECT *, row_number() OVER (PARTITION BY src, port ORDER BY t, no) AS k FROM m WHERE hits >= 3)
        SELECT no, 'Authentication burst' AS signature, concat_ws(' ', service, src, '->', '10.0.0.5') AS detail FROM f WHERE k = 1"""


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{q}')" for q in NEEDLES)
    return {
        "d40_d52_exploits": _found(EXPLOITS),
        "d_bf_services": _login_sql(),
        "d_vuln_exposures": _found(EXPOSURES),
        "r6_many_patterns": """WITH p AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM benchmark), d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
            h AS (SELECT k, doc_id, item_id, w, (length(text) - length(replace(text, w, ''))) // length(w) AS n, strlen(string_split(text, w)[1]) AS first FROM d JOIN p ON contains(text, w)),
            a AS (SELECT k, item_id, count(*) AS patterns FROM h GROUP BY ALL), m AS (SELECT item_id, count(*) AS all_patterns FROM p GROUP BY ALL),
            f AS (SELECT h.* FROM h JOIN a USING (k, item_id) JOIN m USING (item_id) WHERE item_id % 2 = 0 OR patterns = all_patterns)
            SELECT concat('item', item_id) AS rule, w AS pattern, sum(n)::BIGINT AS hits, count(DISTINCT doc_id) AS documents, min(first)::INT AS first_offset FROM f GROUP BY item_id, w""",
        "f18_searches": f"""WITH p AS ({SQL.replace("{events}", "events")}), q AS (SELECT * FROM (VALUES {values}) v(query)),
            s AS (SELECT 'Packet' AS source, concat('#', no, ' ', src, ' → ', dst, ' [', protocol, ']') AS label, info AS detail, concat_ws(' ', src_port, dst_port) AS hay, no AS place FROM p
              UNION ALL SELECT 'Supplier', s_name, CAST(s_nationkey AS VARCHAR), '', s_suppkey FROM supplier),
            r AS (SELECT query, source, label, detail, row_number() OVER (PARTITION BY query, source ORDER BY lpad(CAST(place AS VARCHAR), 20, '0'), label, detail) AS rank
              FROM s JOIN q ON contains(lower(concat_ws(' ', label, detail, hay)), lower(query)))
            SELECT query, source, rank, label, detail FROM r WHERE rank <= CASE source WHEN 'Packet' THEN 20 ELSE 10 END""",
    }
