"""DuckDB text of the fixture views (FIXTURES.md B1), shared by the oracle queries."""

FX = """fx AS (
  SELECT o_orderkey AS art_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'BBC' ELSE 'Guardian' END AS outlet,
    CASE WHEN o_orderkey % 2 = 0 THEN 'RU' ELSE 'IP' END AS topic,
    CASE WHEN o_orderkey % 3 = 0
         THEN 'https://news.example/articles/c' || CAST(o_orderkey AS VARCHAR) || 'o'
         ELSE 'https://news.example/world-' || CAST(o_orderkey + 60395000 AS VARCHAR) END AS url,
    CASE o_orderkey % 5 WHEN 0 THEN 'What if Russia invades' WHEN 1 THEN 'The war diary'
         WHEN 2 THEN 'Ceasefire talks' WHEN 3 THEN 'Markets today' END AS title,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS published_ts,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'LEFT' WHEN '2' THEN 'RIGHT'
         WHEN '3' THEN 'CENTER' WHEN '4' THEN 'error' END AS predicted_label_bert,
    CASE WHEN o_orderkey % 41 = 0 THEN '[ERROR] copyright timeout'
         WHEN o_orderstatus = 'F' THEN ' left ' WHEN o_orderstatus = 'O' THEN 'Centre'
         WHEN o_orderstatus = 'P' THEN 'Right-leaning' END AS predicted_label_deepseek,
    CASE WHEN o_orderkey % 53 = 0 THEN '[Failed]' WHEN o_orderkey % 7 < 3 THEN 'Left'
         WHEN o_orderkey % 7 < 6 THEN 'Center' ELSE 'Right' END AS predicted_label_gemini,
    CASE WHEN o_orderkey % 29 = 0 THEN 'Unknown'
         WHEN o_orderstatus = 'F' THEN 'left' WHEN o_orderstatus = 'O' THEN 'CENTER '
         WHEN o_orderstatus = 'P' THEN 'Right' END AS leaning
  FROM orders)"""

FXL = """fxl AS (
  SELECT art_id, outlet, topic, url, title, published_ts, 'BERT' AS model, predicted_label_bert AS raw_label FROM fx
  UNION ALL
  SELECT art_id, outlet, topic, url, title, published_ts, 'DeepSeek', predicted_label_deepseek FROM fx
  UNION ALL
  SELECT art_id, outlet, topic, url, title, published_ts, 'Gemini', predicted_label_gemini FROM fx)"""

# Python str.strip() equivalent.
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def l1(x: str) -> str:
    s = f"lower({strip(x)})"
    return (f"CASE WHEN {s} LIKE '%left%' THEN 'Left' "
            f"WHEN {s} LIKE '%centre%' OR {s} LIKE '%center%' THEN 'Centre' "
            f"WHEN {s} LIKE '%right%' THEN 'Right' END")


def l3(x: str) -> str:
    s = f"lower({strip(x)})"
    return f"CASE {s} WHEN 'left' THEN 'Left' WHEN 'center' THEN 'Center' WHEN 'right' THEN 'Right' END"


def l7(x: str) -> str:
    return f"CASE {x} WHEN 'Left' THEN -1 WHEN 'Center' THEN 0 WHEN 'Right' THEN 1 END"


def l2score(x: str) -> str:
    s = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    return (f"CASE {s} WHEN 'left' THEN -1 WHEN 'centre' THEN 0 WHEN 'center' THEN 0 "
            f"WHEN 'neutral' THEN 0 WHEN 'right' THEN 1 END")


def l4(x: str) -> str:
    s = strip(x)
    cap = f"(upper(substr({s}, 1, 1)) || lower(substr({s}, 2)))"
    return f"CASE WHEN {cap} = 'Center' THEN 'Centre' ELSE {cap} END"


def cutoff(topic: str, ru: str = "1997-02-24", ip: str = "1999-10-07") -> str:
    return f"CASE {topic} WHEN 'RU' THEN TIMESTAMP '{ru}' WHEN 'IP' THEN TIMESTAMP '{ip}' END"


def ratio(num: str, den: str, empty: str = "NULL") -> str:
    return f"COALESCE(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), {empty})"
