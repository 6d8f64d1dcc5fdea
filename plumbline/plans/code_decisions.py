"""Decision queries over the generated C files."""

from __future__ import annotations

from ..operators import code_decisions as op
from ..operators.code_structure import head_per_group
from .code_corpus import code
from .code_structure import C
from .registry import query

RUN = r"(?:0x[0-9A-Fa-f]{2}\s*[,\s]+){2,}"
COMMAND = r"(?:0x[0-9A-Fa-f]{2},?\s*){4,}"
INTENT = r"(?i)(?://|#|/\*|\*)\s*(TODO|FIXME|HACK|NOTE|WORKAROUND|BUG|OPTIMIZE|REVIEW|XXX|IMPORTANT|WARNING)\s*:?\s*(.+)"
TIMEOUT = r"(?i)(?:timeout|delay|sleep|wait|interval|period|ms|msec|millisec)\s*[=:]\s*(\d+)"
RETRY = r"(?i)(?:retry|retries|attempts|max_attempts|max_retry)\s*[=:]\s*(\d+)"
THREADING = r"(?i)\b(Thread|threading|mutex|semaphore|lock|async|await|concurrent|queue|event|signal)\b"

D = C("c") + rf"""
, t AS (SELECT path AS file, line, text, trim(text) AS bare FROM l),
in_code AS (SELECT * FROM t WHERE NOT regexp_matches(bare, '^(//|#|\*|/\*)')),
d_comment AS (SELECT 'comment' AS kind, regexp_extract(text, '{INTENT}', 1) || ': ' || trim(regexp_extract(text, '{INTENT}', 2)) AS description, file, line, bare AS snippet
              FROM t WHERE regexp_matches(text, '{INTENT}')),
d_byteseq AS (SELECT 'protocol' AS kind, CASE WHEN regexp_matches(text, '{RUN}') THEN 'Hardcoded byte sequence (possible APDU or device command)'
                     ELSE 'Possible APDU command bytes' END AS description, file, line, bare AS snippet FROM in_code
              WHERE regexp_matches(text, '{RUN}') OR (regexp_matches(text, '{COMMAND}') AND (contains(text, '0x00') OR contains(upper(text), 'FF')))),
hex AS (SELECT unnest(regexp_extract_all(text, '\b(0x[0-9A-Fa-f]{{2,8}}|[0-9]{{3,}})\b')) AS v, file, line, bare FROM in_code WHERE NOT regexp_matches(text, '{RUN}')),
d_constant AS (SELECT 'constant' AS kind, 'Hardcoded hex constant: ' || v AS description, file, line, bare AS snippet FROM hex WHERE v LIKE '0x%' AND length(v) >= 6),
d_timing AS (SELECT 'constant' AS kind, 'Timing decision: ' || bare AS description, file, line, bare AS snippet FROM t WHERE regexp_matches(text, '{TIMEOUT}')
             UNION ALL SELECT 'constant', 'Retry/attempt limit: ' || bare, file, line, bare FROM t WHERE regexp_matches(text, '{RETRY}')),
d_winscard AS (SELECT 'protocol' AS kind, 'PC/SC share mode choice: ' || regexp_extract(text, 'SCARD_SHARE_(SHARED|EXCLUSIVE|DIRECT)') || ' — affects multi-app access' AS description,
                      file, line, bare AS snippet FROM t WHERE regexp_matches(text, 'SCARD_SHARE_(SHARED|EXCLUSIVE|DIRECT)')
               UNION ALL SELECT 'protocol', 'PC/SC card disposition on disconnect: ' || regexp_extract(text, 'SCARD_(LEAVE_CARD|RESET_CARD|UNPOWER_CARD|EJECT_CARD)') || ' — affects card state',
                      file, line, bare FROM t WHERE regexp_matches(text, 'SCARD_(LEAVE_CARD|RESET_CARD|UNPOWER_CARD|EJECT_CARD)')
               UNION ALL SELECT 'protocol', 'PC/SC constant usage: ' || regexp_extract(text, '\bSCARD_[A-Z_]+\b'), file, line, bare FROM t WHERE regexp_matches(text, '\bSCARD_[A-Z_]+\b')),
tok AS (SELECT lower(regexp_extract(text, '{THREADING}', 1)) AS token, file, line, bare FROM t WHERE regexp_matches(text, '{THREADING}')),
d_threading AS (SELECT 'threading' AS kind, 'Concurrency/threading: ' || token AS description, file, line, bare AS snippet FROM tok
                QUALIFY row_number() OVER (PARTITION BY file, token ORDER BY line) = 1),
st AS (SELECT file, line AS s, lead(line) OVER (PARTITION BY file ORDER BY line) AS nxt FROM t WHERE regexp_matches(text, '(?:byte|uint8|BYTE|char)\s*\w*\s*\[')),
en AS (SELECT st.file, s, min(t.line) AS e FROM st JOIN t ON t.file = st.file AND t.line >= s AND (nxt IS NULL OR t.line < nxt) AND regexp_matches(text, '[;}}]') GROUP BY ALL),
arr AS (SELECT en.file, s, list_reduce(list(regexp_extract_all(text, '0x[0-9A-Fa-f]{{2}}') ORDER BY t.line), lambda a, b: list_concat(a, b)) AS b
       FROM en JOIN t ON t.file = en.file AND t.line BETWEEN s AND e GROUP BY ALL),
d_byte_array AS (SELECT 'protocol' AS kind, 'Byte array (' || len(b) || ' bytes): ' || array_to_string(b, ' ') AS description,
                        file, s AS line, 'Array starting line ' || s AS snippet FROM arr WHERE len(b) >= 4),
d AS (SELECT *, NULL::VARCHAR AS rationale FROM (SELECT * FROM d_comment UNION ALL SELECT * FROM d_byteseq UNION ALL SELECT * FROM d_constant UNION ALL SELECT * FROM d_timing
      UNION ALL SELECT * FROM d_winscard UNION ALL SELECT * FROM d_threading UNION ALL SELECT * FROM d_byte_array))
"""


def _files(spark, folder):
    return code(spark, folder, "c")


def _scanner(name: str):
    def build(spark, folder):
        return op.line_decisions(op.scan_lines(_files(spark, folder), name))

    build.__name__ = f"decisions_{name}"
    return build


for _name in op.LINE_SCANNERS:
    query(f"decisions_{_name}", D + f"SELECT *, NULL::VARCHAR AS rationale FROM d_{_name}")(_scanner(_name))


@query("decisions_threading", D + "SELECT *, NULL::VARCHAR AS rationale FROM d_threading")
def decisions_threading(spark, folder):
    return op.threading(op.scan_lines(_files(spark, folder)))


@query("decisions_byte_array", D + "SELECT *, NULL::VARCHAR AS rationale FROM d_byte_array")
def decisions_byte_array(spark, folder):
    return op.byte_arrays(op.scan_lines(_files(spark, folder)))


@query("decisions", D + "SELECT * FROM d")
def decisions(spark, folder):
    return op.decisions(_files(spark, folder))


@query("decisions_by_kind", D + "SELECT kind, count(*) AS decisions, count(DISTINCT file) AS files FROM d GROUP BY kind")
def decisions_by_kind(spark, folder):
    return op.by_kind(op.decisions(_files(spark, folder)))


CRITICAL = "kind IN ('protocol', 'constant') OR (kind = 'comment' AND regexp_matches(description, '^(HACK|WORKAROUND|BUG|FIXME)'))"


@query("decisions_critical", D + f"SELECT * FROM d WHERE {CRITICAL}")
def decisions_critical(spark, folder):
    return op.critical(op.decisions(_files(spark, folder)))


@query("decisions_summary", D + """
, n AS (SELECT kind, count(*) AS n FROM d GROUP BY kind)
SELECT 'Found ' || CAST(sum(n) AS BIGINT) || ' decisions: ' || string_agg(n || ' ' || kind, ', ' ORDER BY n DESC, kind) AS summary FROM n""")
def decisions_summary(spark, folder):
    return op.summary(op.decisions(_files(spark, folder)))


@query("report_decisions", D + """
SELECT kind, file, line, description, CAST(row_number() OVER (PARTITION BY kind ORDER BY file, line, description) AS INTEGER) AS rank,
       greatest(count(*) OVER (PARTITION BY kind) - 15, 0) AS more FROM d QUALIFY rank <= 15""")
def report_decisions(spark, folder):
    rows = op.decisions(_files(spark, folder)).select("kind", "file", "line", "description")
    return head_per_group(rows, ["kind"], 15, "file", "line", "description")


@query("report_critical", D + f"SELECT kind, file, line, description FROM d WHERE {CRITICAL} ORDER BY file, line, kind, description LIMIT 30")
def report_critical(spark, folder):
    rows = op.critical(op.decisions(_files(spark, folder))).select("kind", "file", "line", "description")
    return rows.orderBy("file", "line", "kind", "description").limit(30)
