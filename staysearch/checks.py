"""The registered queries as SQL, for a side-by-side run on the same tables.

Written independently of the DataFrame code, from the bindings and the contract.
"""

from __future__ import annotations

AVAILABILITY_LOG = """
availability_log AS (
    SELECT l_suppkey AS placement_id, CAST(l_shipdate AS DATE) AS date,
           CAST(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS SMALLINT) AS available,
           l_shipdate + l_linenumber * INTERVAL 1 HOUR AS updated_at,
           l_orderkey, l_linenumber, l_partkey, l_extendedprice
    FROM lineitem WHERE l_linestatus = 'F')"""

PRICE_LOG = """
price_log AS (
    SELECT l_suppkey AS placement_id, CAST(l_shipdate AS DATE) AS date,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
           CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'R' THEN 'EUR' ELSE 'RUB' END AS currency,
           l_shipdate + l_linenumber * INTERVAL 1 HOUR AS updated_at,
           l_orderkey, l_linenumber, l_partkey, l_extendedprice
    FROM lineitem WHERE l_linestatus = 'O')"""

VARIANT_LOG = """
variant_log AS (
    SELECT l_suppkey AS placement_id, CAST(l_partkey % 5 AS SMALLINT) AS adults,
           CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN '' WHEN 1 THEN '5' WHEN 2 THEN '10'
                WHEN 3 THEN '10, 5' ELSE '7,3,0' END AS raw,
           CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN '' WHEN 1 THEN '5' WHEN 2 THEN '10'
                WHEN 3 THEN '5,10' ELSE '3,7' END AS children_ages,
           l_shipdate + l_linenumber * INTERVAL 1 HOUR AS updated_at,
           l_orderkey, l_linenumber, l_partkey, l_extendedprice
    FROM lineitem)"""

LOG_ORDER = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC"


def _latest(name: str, log: str, keys: str, order: str = LOG_ORDER, where: str = "placement_id > 0") -> str:
    return f"""
{name} AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn
                   FROM {log} WHERE {where}) WHERE rn = 1)"""


AVAILABILITY = AVAILABILITY_LOG + "," + _latest("availability", "availability_log", "placement_id, date")
PRICES = PRICE_LOG + "," + _latest("prices", "price_log", "placement_id, date")

HOTELS = """
hotels AS (
    SELECT CAST(n_nationkey AS BIGINT) AS hotel_id, n_name AS name, r_name AS city
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""

PLACEMENTS = """
placements AS (
    SELECT s_suppkey AS placement_id, CAST(s_nationkey AS BIGINT) AS hotel_id, s_name AS name
    FROM supplier)"""

TEMPLATES = """
templates AS (
    SELECT CAST(a AS SMALLINT) AS adults, c AS children_ages
    FROM (VALUES (1), (2), (3), (4)) AS t(a), (VALUES (''), ('5'), ('10'), ('5,10'), ('3,7')) AS u(c))"""

VARIANTS = TEMPLATES + """,
variants AS (
    SELECT s_suppkey AS placement_id, adults, children_ages
    FROM supplier, templates WHERE s_suppkey > 0)"""

DAY_COLUMNS = """
           COALESCE(a.available, CAST(0 AS SMALLINT)) AS available,
           COALESCE(p.price, CAST(0 AS DECIMAL(12,2))) AS price,
           COALESCE(p.currency, 'RUB') AS currency,
           epoch_ms(GREATEST(COALESCE(a.updated_at, p.updated_at), COALESCE(p.updated_at, a.updated_at))) AS updated_ms"""


def _days(join: str) -> str:
    return f"""
days AS (
    SELECT COALESCE(a.placement_id, p.placement_id) AS placement_id, COALESCE(a.date, p.date) AS date,{DAY_COLUMNS}
    FROM availability a {join} JOIN prices p ON a.placement_id = p.placement_id AND a.date = p.date)"""


SEARCH_COLUMNS = "placement_id, date, adults, children_ages, available, price, currency, updated_ms"


def _search(join: str = "LEFT") -> str:
    return (
        AVAILABILITY + "," + PRICES + "," + _days(join) + "," + VARIANTS
        + """,
search AS (
    SELECT d.placement_id, d.date, v.adults, v.children_ages, d.available, d.price, d.currency, d.updated_ms
    FROM days d JOIN variants v ON d.placement_id = v.placement_id)"""
    )


STAY = "adults = 2 AND children_ages = '5,10' AND date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'"
TYPED_DAY = "date, CAST(available AS BOOLEAN) AS available, CAST(price AS DOUBLE) AS price, currency"
TOTALS = f"""
totals AS (
    SELECT placement_id, CAST(SUM(price) AS DECIMAL(18,2)) AS total_price,
           CAST(MIN(available) AS BOOLEAN) AS available, MIN(currency) AS currency, COUNT(*) AS days_found
    FROM search WHERE {STAY} GROUP BY placement_id)"""
DIRECTORY = HOTELS + "," + PLACEMENTS + """,
directory AS (
    SELECT p.placement_id, p.hotel_id, p.name AS placement_name, h.name AS hotel_name, h.city
    FROM placements p JOIN hotels h ON p.hotel_id = h.hotel_id)"""

DATE_TEXT = "strftime(date, '%Y-%m-%d')"
AVAILABILITY_PAYLOAD = (
    f"""'{{"placement_id":' || placement_id || ',"date":"' || {DATE_TEXT} || '","available":' || available || '}}'"""
)
PRICE_PAYLOAD = (
    f"""'{{"placement_id":' || placement_id || ',"date":"' || {DATE_TEXT} || '","price":"' || price"""
    """ || '","currency":"' || CASE currency WHEN 'RUB' THEN '' ELSE currency END || '"}'"""
)
VARIANT_PAYLOAD = (
    """'{"placement_id":' || placement_id || ',"adults":' || adults || ',"children_ages":"' || raw || '"}'"""
)

EVENTS = """
changes AS (
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS placement_id,
           CAST(ts AS DATE) AS date, event_type <> 'error' AS available
    FROM events)"""
EVENT_PAYLOAD = (
    """'{"placement_id":"' || placement_id || '","date":' || (date - DATE '1970-01-01')"""
    """ || ',"available":' || CASE WHEN available THEN 'true' ELSE 'false' END || '}'"""
)

# Quarantined rows: key 0. Variants with 0 adults are refused for the key as well.
QUARANTINE = AVAILABILITY_LOG + "," + PRICE_LOG + "," + VARIANT_LOG + f""",
quarantine AS (
    SELECT 'availability' AS source, placement_id, {AVAILABILITY_PAYLOAD} AS payload, 'bad_key' AS reason
    FROM availability_log WHERE placement_id <= 0
    UNION ALL
    SELECT 'prices_by_day', placement_id, {PRICE_PAYLOAD}, 'bad_key' FROM price_log WHERE placement_id <= 0
    UNION ALL
    SELECT 'placement_variants', placement_id, {VARIANT_PAYLOAD}, 'bad_key'
    FROM variant_log WHERE placement_id <= 0)"""

CHANGE_REQUESTS = PLACEMENTS + """,
requests AS (
    SELECT o_orderkey AS request_id,
           CASE WHEN o_orderstatus = 'O' THEN 'availability' ELSE 'price' END AS kind,
           o_custkey AS placement_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) END AS date,
           CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
                THEN CAST(o_orderdate AS DATE) END AS date_from,
           CAST(o_orderdate AS DATE) + CAST(CASE o_orderpriority
                WHEN '2-HIGH' THEN 9 WHEN '3-MEDIUM' THEN o_custkey % 400
                WHEN '4-NOT SPECIFIED' THEN 2 - o_custkey % 4 END AS INTEGER) AS date_to,
           CASE WHEN o_custkey % 7 = 0 THEN 2 WHEN o_custkey % 7 < 4 THEN 1 ELSE 0 END AS flag,
           CAST(o_totalprice AS DECIMAL(12,2)) - 20000 AS price,
           CASE WHEN o_orderstatus = 'F' THEN 'EUR' WHEN o_custkey % 5 = 0 THEN 'RU' END AS currency
    FROM orders),
checked AS (
    SELECT r.*, concat_ws(',',
        CASE WHEN p.placement_id IS NULL THEN 'placement_unknown' END,
        CASE WHEN r.date IS NULL AND (date_from IS NULL OR date_to IS NULL) THEN 'date_required' END,
        CASE WHEN date_to < date_from THEN 'range_reversed' END,
        CASE WHEN date_to - date_from + 1 > 366 THEN 'range_too_long' END,
        CASE WHEN kind = 'availability' AND flag = 2 THEN 'available_invalid' END,
        CASE WHEN kind = 'price' AND price < 0 THEN 'price_invalid' END,
        CASE WHEN kind = 'price' AND length(currency) <> 3 THEN 'currency_invalid' END) AS errors
    FROM requests r LEFT JOIN placements p ON r.placement_id = p.placement_id),
good AS (
    SELECT *, COALESCE(date, date_from) AS first_day, COALESCE(date, date_to) AS last_day
    FROM checked WHERE errors = ''),
change_days AS (
    SELECT g.* EXCLUDE (date), CAST(u.d AS DATE) AS date
    FROM good g, UNNEST(generate_series(CAST(first_day AS TIMESTAMP), CAST(last_day AS TIMESTAMP), INTERVAL 1 DAY)) AS u(d))"""


def _upserted(kind: str, table: str, values: str, changed: str) -> str:
    return f"""
    both_sides AS (
        SELECT placement_id, date, {values}, -1 AS request_id FROM {table}
        UNION ALL
        SELECT placement_id, date, {changed}, request_id FROM change_days WHERE kind = '{kind}')
    SELECT placement_id, date, {values} FROM (
        SELECT *, row_number() OVER (PARTITION BY placement_id, date ORDER BY request_id DESC) AS rn
        FROM both_sides) WHERE rn = 1"""


LEGACY = """
owned AS (SELECT s_suppkey AS placement_id, s_suppkey // 2 AS hotel_id FROM supplier),
known AS (
    SELECT c_custkey AS hotel_id, (SELECT MIN(placement_id) FROM owned WHERE hotel_id = c_custkey) AS own
    FROM customer),
firsts AS (
    SELECT hotel_id, COALESCE(own, (SELECT MAX(placement_id) FROM owned)
           + SUM(CASE WHEN own IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY hotel_id)) AS placement_id
    FROM known)"""

MASK = 4294967295


def _mixed(a: str, b: str, seed: int) -> str:
    x = f"((({a} % {MASK}) * 1000003 + {b} * 8191 + {seed * 131071}) & {MASK})"
    return f"""
    m0 AS (SELECT *, CAST({x} AS BIGINT) AS x0 FROM demo),
    m1 AS (SELECT *, (xor(x0, x0 >> 16) * 73244475) & {MASK} AS x1 FROM m0),
    m2 AS (SELECT *, (xor(x1, x1 >> 16) * 73244475) & {MASK} AS x2 FROM m1),
    m3 AS (SELECT *, xor(x2, x2 >> 16) AS x FROM m2)"""


DEMO = """
demo AS (
    SELECT s_suppkey AS placement_id, CAST(d AS BIGINT) AS d,
           CAST(DATE '2026-01-01' + CAST(d AS INTEGER) AS DATE) AS date
    FROM supplier, range(365) AS r(d)),"""

VARIANT_STATE = VARIANT_LOG + "," + _latest(
    "variant_state", "variant_log", "placement_id, adults, children_ages", where="placement_id > 0 AND adults > 0"
)


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().rstrip(',')}\n{body}"


def _counts(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS entity, COUNT(*) AS cnt FROM {table}" for name, table in parts.items())


ANALYTIC = {
    "placement_variants": "variants",
    "availability_final": "availability",
    "prices_by_day_final": "prices",
    "search_by_variant": "search",
}


# Columns that leave a query as text (dates) or double (money), where not (date, price).
_NONE: tuple[str, ...] = ()
_DATE = ("date",)
EDGE = {
    **dict.fromkeys(
        [
            "latest_availability", "latest_by_update_time", "compact_equivalence",
            "decode_availability_events", "event_latest", "sample_days", "range_upsert",
            "insert_if_absent", "demo_availability", "stream_latest_availability", "stream_restart",
            "latest_across_partitions", "stream_replay", "ingest_changes", "stream_state_latest",
            "content_differences", "stream_redefine",
        ],
        _DATE,
    ),
    **dict.fromkeys(["stay_totals", "stay_totals_stored", "stay_totals_open_delta", "stay_totals_by_hotel", "stay_totals_requests"], ("total_price",)),
    "change_receipts": ("first_day", "last_day"),
    **dict.fromkeys(
        [
            "latest_variants", "decode_variant_events", "event_quarantine", "quarantine_log",
            "quarantine_counts", "corrupt_messages", "stay_summary", "hotel_placement_counts",
            "placement_list", "hotel_detail", "placement_variant_rows", "table_counts", "reconciliation", "variant_profile",
            "variants_by_adults", "search_by_adults_available", "normalized_ages", "rejected_changes",
            "unknown_placement_changes", "rekey_backfill", "rekey_first_placements", "demo_variants",
            "json_lines_load", "variant_sync", "repair_counts", "stream_variants", "stream_quarantine",
            "stay_nested", "stay_totals_nested", "placement_variants_nested", "rejected_stays", "unique_placements", "diagnosis", "stream_progress",
        ],
        _NONE,
    ),
}
MONEY = ("price", "total_price")


def _at_edge(sql: str, *columns: str) -> str:
    if not columns:
        return sql
    casts = ", ".join(
        f"CAST({c} AS {'DOUBLE' if c in MONEY else 'VARCHAR'}) AS {c}" for c in columns
    )
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    availability = "SELECT placement_id, date, available, epoch_ms(updated_at) AS updated_ms FROM availability"
    price = "SELECT placement_id, date, price, currency, epoch_ms(updated_at) AS updated_ms FROM prices"
    variant_rows = "SELECT placement_id, adults, children_ages FROM variant_state"
    search_rows = f"SELECT {SEARCH_COLUMNS} FROM search"
    event_counts = EVENTS + """,
    refused AS (
        SELECT CASE WHEN placement_id <= 0 THEN 'bad_key' ELSE 'usable' END AS reason FROM changes
        UNION ALL SELECT 'corrupt' FROM documents)"""
    queries = {
        "latest_availability": _with(AVAILABILITY, availability),
        "latest_price": _with(PRICES, price),
        "latest_variants": _with(
            VARIANT_STATE,
            "SELECT placement_id, adults, children_ages, epoch_ms(updated_at) AS updated_ms FROM variant_state",
        ),
        "latest_by_update_time": _with(
            AVAILABILITY_LOG
            + ","
            + _latest("availability", "availability_log", "placement_id, date", f"epoch_ms(updated_at) DESC, {LOG_ORDER}"),
            "SELECT placement_id, date, available, epoch_ms(updated_at) AS updated_ms FROM availability",
        ),
        "compact_equivalence": _with(AVAILABILITY, availability),
        "decode_availability_events": _with(
            AVAILABILITY_LOG, "SELECT placement_id, date, available FROM availability_log WHERE placement_id > 0"
        ),
        "decode_price_events": _with(
            PRICE_LOG, "SELECT placement_id, date, price, currency FROM price_log WHERE placement_id > 0"
        ),
        "decode_variant_events": _with(
            VARIANT_LOG,
            "SELECT placement_id, adults, children_ages FROM variant_log WHERE placement_id > 0 AND adults > 0",
        ),
        "cdc_envelopes": _with(
            PRICE_LOG,
            "SELECT placement_id, date, price, 'RUB' AS currency FROM price_log WHERE placement_id > 0 AND currency <> 'EUR'",
        ),
        "event_latest": _with(
            EVENTS + "," + _latest("state", "changes", "placement_id, date", "event_id DESC"),
            "SELECT placement_id, date, CAST(available AS SMALLINT) AS available FROM state",
        ),
        "event_quarantine": _with(
            EVENTS,
            f"""SELECT 'availability' AS source, placement_id, {EVENT_PAYLOAD} AS payload, 'bad_key' AS reason
                FROM changes WHERE placement_id <= 0""",
        ),
        "quarantine_log": _with(QUARANTINE, "SELECT * FROM quarantine"),
        "quarantine_counts": _with(
            QUARANTINE, "SELECT source, reason, COUNT(*) AS cnt FROM quarantine GROUP BY source, reason"
        ),
        "corrupt_messages": _with(event_counts, "SELECT reason, COUNT(*) AS cnt FROM refused GROUP BY reason"),
        "snapshot_then_changes": _with(
            PRICES,
            """SELECT placement_id, date, price,
                      CASE WHEN date >= DATE '1997-03-01' THEN 'NEW' ELSE currency END AS currency FROM prices""",
        ),
        "day_state_by_availability": _with(AVAILABILITY + "," + PRICES + "," + _days("LEFT"), "SELECT * FROM days"),
        "day_state_by_price": _with(AVAILABILITY + "," + PRICES + "," + _days("RIGHT"), "SELECT * FROM days"),
        "search_refresh": _with(_search(), search_rows),
        "search_refresh_stored": None,
        "search_refresh_partial": _with(
            _search(),
            search_rows
            + " WHERE placement_id = 5 AND date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'",
        ),
        "search_incremental": _with(_search("FULL"), search_rows),
        "search_two_feeds": None,
        "stay_days_by_placement": _with(_search(), f"SELECT {TYPED_DAY} FROM search WHERE {STAY} AND placement_id = 5"),
        "stay_days_all": _with(_search(), f"SELECT placement_id, {TYPED_DAY} FROM search WHERE {STAY}"),
        "stay_days_by_hotel": _with(
            _search() + "," + DIRECTORY,
            f"""SELECT placement_id, {TYPED_DAY}, hotel_id, placement_name, hotel_name, city
                FROM search JOIN directory USING (placement_id) WHERE {STAY}""",
        ),
        "stay_totals": _with(_search() + "," + TOTALS, "SELECT * FROM totals"),
        "stay_totals_stored": None,
        "stay_totals_by_hotel": _with(
            _search() + "," + TOTALS + "," + DIRECTORY, "SELECT * FROM totals JOIN directory USING (placement_id)"
        ),
        "stay_summary": _with(
            _search() + "," + TOTALS + "," + DIRECTORY,
            """SELECT COUNT(DISTINCT hotel_id) AS hotels_found, COUNT(*) AS placements_found
               FROM totals JOIN directory USING (placement_id)""",
        ),
        "stay_nested": _with(
            _search() + "," + DIRECTORY + f""",
            stays AS (
                SELECT placement_id, string_agg(concat_ws('|', {DATE_TEXT}, CAST(CAST(available AS BOOLEAN) AS VARCHAR),
                           CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), currency), ';' ORDER BY date) AS days
                FROM search WHERE {STAY} GROUP BY placement_id)""",
            """SELECT hotel_id, hotel_name AS name, city, 0 AS page,
                      string_agg(concat_ws(':', placement_id, placement_name, days), '/' ORDER BY placement_id) AS placements
               FROM stays JOIN directory USING (placement_id) GROUP BY hotel_id, hotel_name, city""",
        ),
        "stay_totals_nested": _with(
            _search() + "," + TOTALS + "," + DIRECTORY,
            """SELECT hotel_id, hotel_name AS name, city, 0 AS page,
                      string_agg(concat_ws('|', placement_id, placement_name, CAST(total_price AS VARCHAR),
                          CAST(available AS VARCHAR), currency, days_found), '/' ORDER BY placement_id) AS placements
               FROM totals JOIN directory USING (placement_id) GROUP BY hotel_id, hotel_name, city""",
        ),
        "placement_variants_nested": _with(
            PLACEMENTS + "," + VARIANTS,
            """SELECT p.hotel_id, p.placement_id, p.name, 0 AS page,
                      COALESCE(string_agg(concat_ws('|', v.adults, v.children_ages,
                          v.adults || ' взр.' || CASE WHEN v.children_ages = '' THEN ''
                              ELSE ', дети ' || replace(v.children_ages, ',', ', ') END), ';'
                          ORDER BY v.adults, v.children_ages) FILTER (WHERE v.adults IS NOT NULL), '') AS variants
               FROM placements p LEFT JOIN variants v ON v.placement_id = p.placement_id
               GROUP BY p.hotel_id, p.placement_id, p.name""",
        ),
        "rejected_stays": _with(
            PLACEMENTS + """,
            requests AS (
                SELECT o_orderkey AS request_id,
                       CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS placement_id,
                       o_custkey % 5 AS adults FROM orders)""",
            """SELECT * FROM (
                   SELECT request_id, placement_id, concat_ws(',', CASE WHEN adults < 1 THEN 'adults_invalid' END,
                       CASE WHEN placement_id IS NOT NULL AND placement_id NOT IN (SELECT placement_id FROM placements)
                            THEN 'placement_unknown' END) AS errors
                   FROM requests) WHERE errors <> ''""",
        ),
        "stay_requests_batch": _with(
            _search() + """,
            requests AS (
                SELECT o_orderkey AS request_id,
                       CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS placement_id,
                       CAST(o_orderdate AS DATE) AS date_from,
                       CAST(o_orderdate AS DATE) + CAST(o_custkey % 3 AS INTEGER) AS date_to,
                       o_custkey % 5 AS adults,
                       CASE o_orderstatus WHEN 'F' THEN '5,10' WHEN 'O' THEN '5' ELSE '' END AS children_ages
                FROM orders)""",
            """SELECT r.request_id, s.placement_id, s.date, s.available, s.price, s.currency
               FROM requests r JOIN search s
                 ON r.adults = s.adults AND r.children_ages = s.children_ages
                AND s.date BETWEEN r.date_from AND r.date_to
                AND (r.placement_id IS NULL OR r.placement_id = s.placement_id)
               WHERE r.adults > 0""",
        ),
        "calendar": _with(
            AVAILABILITY + "," + PRICES,
            """SELECT a.date, a.available, p.price, p.currency
               FROM availability a LEFT JOIN prices p ON a.placement_id = p.placement_id AND a.date = p.date
               WHERE a.placement_id = 5 AND a.date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'""",
        ),
        "hotel_placement_counts": _with(
            HOTELS + "," + PLACEMENTS,
            """SELECT h.hotel_id, h.name, h.city, COUNT(p.placement_id) AS placements_count
               FROM hotels h LEFT JOIN placements p ON h.hotel_id = p.hotel_id GROUP BY ALL""",
        ),
        "placement_list": _with(
            HOTELS + "," + PLACEMENTS,
            """SELECT p.hotel_id, p.placement_id, p.name, h.name AS hotel_name
               FROM placements p LEFT JOIN hotels h ON h.hotel_id = p.hotel_id""",
        ),
        "hotel_detail": _with(
            HOTELS + "," + PLACEMENTS + "," + VARIANTS,
            """SELECT h.hotel_id, h.name AS hotel_name, COALESCE(p.placement_id, -1) AS placement_id,
                      COALESCE(p.name, '') AS placement_name,
                      COALESCE(v.adults, CAST(0 AS SMALLINT)) AS adults,
                      COALESCE(v.children_ages, '') AS children_ages,
                      COALESCE(v.adults || ' взр.' || CASE WHEN v.children_ages = '' THEN ''
                          ELSE ', дети ' || replace(v.children_ages, ',', ', ') END, '') AS label
               FROM hotels h LEFT JOIN placements p ON p.hotel_id = h.hotel_id
               LEFT JOIN variants v ON v.placement_id = p.placement_id""",
        ),
        "placement_variant_rows": _with(
            PLACEMENTS + "," + VARIANTS,
            """SELECT p.hotel_id, p.placement_id, p.name,
                      COALESCE(v.adults, CAST(0 AS SMALLINT)) AS adults,
                      COALESCE(v.children_ages, '') AS children_ages,
                      COALESCE(v.adults || ' взр.' || CASE WHEN v.children_ages = '' THEN ''
                          ELSE ', дети ' || replace(v.children_ages, ',', ', ') END, '') AS label
               FROM placements p LEFT JOIN variants v ON v.placement_id = p.placement_id""",
        ),
        "table_counts": _with(_search(), _counts(ANALYTIC)),
        "reconciliation": _with(
            _search() + "," + HOTELS + "," + PLACEMENTS + """,
            source_counts AS ("""
            + _counts(
                {
                    "hotels": "hotels",
                    "placements": "placements",
                    "placement_variants": "variants",
                    "availability": "(SELECT DISTINCT placement_id, date FROM availability_log)",
                    "prices_by_day": "(SELECT DISTINCT placement_id, date FROM price_log)",
                }
            )
            + """),
            analytic_counts AS ("""
            + _counts(
                {
                    "placement_variants": "variants",
                    "availability": "availability",
                    "prices_by_day": "prices",
                    "search_by_variant": "search",
                }
            )
            + ")",
            """SELECT entity, COALESCE(CAST(s.cnt AS VARCHAR), '—') AS source_cnt,
                      COALESCE(CAST(a.cnt AS VARCHAR), '—') AS analytic_cnt,
                      COALESCE(CAST(s.cnt - a.cnt AS VARCHAR), '—') AS diff
               FROM source_counts s FULL JOIN analytic_counts a USING (entity)""",
        ),
        "variant_profile": _with(
            VARIANTS,
            """SELECT COUNT(*) AS total_rows, COUNT(DISTINCT placement_id) AS unique_placements,
                      MIN(placement_id) AS min_placement_id, MAX(placement_id) AS max_placement_id,
                      MIN(adults) AS min_adults, MAX(adults) AS max_adults FROM variants""",
        ),
        "variants_by_adults": _with(
            VARIANTS,
            "SELECT adults, COUNT(*) AS cnt FROM variants WHERE adults > 0 GROUP BY adults ORDER BY adults LIMIT 10",
        ),
        "search_by_adults_available": _with(
            _search(),
            """SELECT adults, available, COUNT(*) AS cnt FROM search WHERE placement_id = 1 AND adults > 0
               GROUP BY adults, available ORDER BY adults, available LIMIT 10""",
        ),
        "sample_days": _with(
            AVAILABILITY,
            """SELECT date, available, epoch_ms(updated_at) AS updated_ms FROM availability
               WHERE placement_id = 1 ORDER BY date LIMIT 3""",
        ),
        "normalized_ages": _with(
            VARIANT_LOG, "SELECT raw, children_ages AS ages, COUNT(*) AS cnt FROM variant_log GROUP BY ALL"
        ),
        "range_upsert": _with(
            AVAILABILITY + "," + CHANGE_REQUESTS + ",",
            "",
        )
        + "," + _upserted("availability", "availability", "available", "CAST(flag AS SMALLINT)"),
        "price_upsert": _with(
            PRICES + "," + CHANGE_REQUESTS + ",",
            "",
        )
        + "," + _upserted(
            "price", "prices", "price, currency", "CAST(price AS DECIMAL(12,2)) AS price, COALESCE(currency, 'RUB') AS currency"
        ),
        "change_receipts": _with(
            CHANGE_REQUESTS,
            """SELECT request_id, kind, placement_id, CAST(last_day - first_day + 1 AS INTEGER) AS days,
                      first_day, last_day FROM good""",
        ),
        "changes_as_events": _with(
            CHANGE_REQUESTS,
            """SELECT placement_id, date, CAST(price AS DECIMAL(12,2)) AS price, COALESCE(currency, 'RUB') AS currency
               FROM (SELECT *, row_number() OVER (PARTITION BY placement_id, date ORDER BY request_id DESC) AS rn
                     FROM change_days WHERE kind = 'price' AND placement_id > 0) WHERE rn = 1""",
        ),
        "rejected_changes": _with(
            CHANGE_REQUESTS, "SELECT request_id, kind, placement_id, errors FROM checked WHERE errors <> ''"
        ),
        "unknown_placement_changes": _with(
            CHANGE_REQUESTS,
            "SELECT request_id, placement_id FROM requests WHERE placement_id NOT IN (SELECT placement_id FROM placements)",
        ),
        "insert_if_absent": _with(
            AVAILABILITY_LOG
            + ","
            + PRICES
            + ","
            + _latest("offered", "availability_log", "placement_id, date", LOG_ORDER.replace(" DESC", "")),
            """SELECT o.placement_id, o.date, o.available FROM offered o
               WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.placement_id = o.placement_id AND p.date = o.date)""",
        ),
        "rekey_backfill": _with(
            LEGACY,
            """SELECT CAST(f.placement_id AS BIGINT) AS placement_id, o.o_orderkey
               FROM orders o JOIN firsts f ON f.hotel_id = o.o_custkey""",
        ),
        "rekey_first_placements": _with(
            LEGACY, "SELECT hotel_id, CAST(placement_id AS BIGINT) AS placement_id FROM firsts"
        ),
        "demo_availability": _with(
            DEMO + _mixed("placement_id", "d", 1),
            "SELECT placement_id, date, CAST(CASE WHEN x % 100 < 80 THEN 1 ELSE 0 END AS SMALLINT) AS available FROM m3",
        ),
        "demo_prices": _with(
            DEMO + _mixed("placement_id", "d", 2),
            """SELECT placement_id, date, CAST(5000 + (d % 30) * 100 + (x % 21) * 50 AS DECIMAL(12,2)) AS price,
                      'RUB' AS currency FROM m3""",
        ),
        "demo_variants": _with(
            TEMPLATES, "SELECT s_suppkey AS placement_id, adults, children_ages FROM supplier, templates"
        ),
        "tsv_roundtrip": _with(PRICES, "SELECT placement_id, date, price, currency FROM prices"),
        "json_lines_load": _with(VARIANTS, "SELECT * FROM variants"),
        "variant_sync": _with(VARIANTS, "SELECT *, (SELECT COUNT(*) FROM variants) AS copied FROM variants"),
        "repair_counts": _with(_search(), _counts(ANALYTIC)),
        "stream_latest_availability": _with(AVAILABILITY, "SELECT placement_id, date, available FROM availability"),
        "stream_latest_price": _with(PRICES, "SELECT placement_id, date, price, currency FROM prices"),
        "stream_variants": _with(VARIANT_STATE, variant_rows),
        "stream_quarantine": _with(
            event_counts,
            """SELECT 'availability' AS source, reason, COUNT(*) AS cnt FROM refused
               WHERE reason <> 'usable' GROUP BY reason""",
        ),
        "stream_restart": _with(
            AVAILABILITY,
            """SELECT placement_id, date, COUNT(*) AS changes, MIN(a.available) AS available
               FROM availability_log l JOIN (SELECT placement_id, date, available FROM availability) a
               USING (placement_id, date) GROUP BY placement_id, date""",
        ),
        "stay_totals_requests": _with(
            _search() + """,
            requests AS (
                SELECT o_orderkey AS request_id,
                       CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS placement_id,
                       CAST(o_orderdate AS DATE) AS date_from,
                       CAST(o_orderdate AS DATE) + CAST(o_custkey % 3 AS INTEGER) AS date_to,
                       o_custkey % 5 AS adults,
                       CASE o_orderstatus WHEN 'F' THEN '5,10' WHEN 'O' THEN '5' ELSE '' END AS children_ages
                FROM orders)""",
            """SELECT r.request_id, s.placement_id, CAST(SUM(s.price) AS DECIMAL(18,2)) AS total_price,
                      CAST(MIN(s.available) AS BOOLEAN) AS available, MIN(s.currency) AS currency, COUNT(*) AS days_found
               FROM requests r JOIN search s
                 ON r.adults = s.adults AND r.children_ages = s.children_ages
                AND s.date BETWEEN r.date_from AND r.date_to
                AND (r.placement_id IS NULL OR r.placement_id = s.placement_id)
               GROUP BY r.request_id, s.placement_id""",
        ),
        "search_refresh_ranges": _with(
            _search() + "," + CHANGE_REQUESTS,
            f"""SELECT {SEARCH_COLUMNS} FROM search SEMI JOIN (
                    SELECT DISTINCT placement_id, date FROM change_days WHERE kind = 'availability') USING (placement_id, date)""",
        ),
        "content_differences": _with(
            PRICES,
            """SELECT placement_id, date, 'changed' AS reason FROM prices
               WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND placement_id % 7 = 0
               UNION ALL SELECT placement_id, date, 'missing' FROM prices
               WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND placement_id % 7 = 1
               UNION ALL SELECT -placement_id, date, 'surplus' FROM prices
               WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND placement_id % 7 = 2""",
        ),
        "unique_placements": _with(
            AVAILABILITY,
            """SELECT year(date) AS period, COUNT(DISTINCT placement_id) AS placements, true AS near
               FROM availability GROUP BY year(date)
               UNION ALL SELECT 0, COUNT(DISTINCT placement_id), true FROM availability""",
        ),
        "diagnosis": _with(
            _search(),
            """SELECT 'variants_by_adults' AS part, concat_ws('|', adults, COUNT(*)) AS what FROM variants GROUP BY adults
               UNION ALL (SELECT 'sample_days', concat_ws('|', strftime(date, '%Y-%m-%d'), available)
                          FROM availability WHERE placement_id = 1 ORDER BY date LIMIT 3)
               UNION ALL SELECT 'search_by_adults', concat_ws('|', adults, available, COUNT(*))
                         FROM search WHERE placement_id = 1 GROUP BY adults, available""",
        ),
        "stream_redefine": _with(
            PRICE_LOG,
            """SELECT placement_id, date, CASE WHEN date < DATE '1997-03-01' THEN currency ELSE lower(currency) END AS currency,
                      COUNT(*) AS changes
               FROM price_log WHERE placement_id > 0 GROUP BY ALL""",
        ),
        "stream_progress": _with(
            AVAILABILITY,
            """SELECT 'progress' AS name, CAST((SELECT COUNT(*) FROM availability_log) AS BIGINT) AS input_rows,
                      CAST((SELECT COUNT(*) FROM availability) AS BIGINT) AS state_rows""",
        ),
        "stream_search": _with(
            _search("FULL"),
            "SELECT placement_id, date, adults, children_ages, available, price, currency FROM search",
        ),
    }
    # Different ways to the same rows.
    queries["search_refresh_stored"] = queries["search_refresh"]
    queries["search_two_feeds"] = queries["search_incremental"]
    queries["stay_nested_rows"] = queries["stay_days_by_hotel"]
    queries["stay_totals_stored"] = queries["stay_totals_open_delta"] = queries["stay_totals"]
    queries["search_refresh_beside_stream"] = queries["search_refresh"]
    queries["latest_across_partitions"] = queries["stream_replay"] = queries["stream_latest_availability"]
    queries["search_backfill_variants"] = queries["search_refresh"]
    queries["stream_state_latest"] = queries["stream_latest_availability"]
    queries["ingest_changes"] = queries["range_upsert"]
    return {name: _at_edge(sql, *EDGE.get(name, ("date", "price"))) for name, sql in queries.items()}
