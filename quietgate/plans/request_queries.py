"""Request inspection, chat turns, pages and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import requests as req
from ..sources import readers
from .catalog import Catalog
from .scan_queries import rules_sql

CATALOG = Catalog()


def bodies(requests):
    return requests.withColumn("body", F.encode("body_text", "UTF-8")).drop("body_text", "text")


_READ = """CASE WHEN method = 'CONNECT' OR path LIKE '%FF' OR content_type LIKE '%latin1'
      OR (content_type = 'application/json' AND body_text LIKE '%,') THEN false ELSE true END"""
_FLAGS = rules_sql("requests", "text", "text", "*")
DECIDED_REQUESTS = f"""SELECT id, host, method, conv_id, turn, cast(strlen(body_text) as bigint) AS body_len,
      CASE WHEN NOT ({_READ}) THEN 'uninspectable_request' WHEN rules <> '' OR path LIKE '%mail=%' THEN 'sensitive_data' ELSE 'clean' END AS reason,
      CASE WHEN NOT ({_READ}) THEN '' WHEN path LIKE '%mail=%' AND rules NOT LIKE '%email%'
        THEN concat_ws(',', nullif(rules, ''), 'email') ELSE rules END AS rules
    FROM ({_FLAGS}) f"""


@CATALOG.add("requests", sql=f"SELECT id, reason, rules FROM ({DECIDED_REQUESTS}) d")
def inspect_requests(requests):
    return req.inspect_requests(bodies(requests)).select(
        "id", "reason", F.array_join("rules", ",").alias("rules")
    )


@CATALOG.add(
    "requests",
    sql=f"""SELECT id, body_len, CASE WHEN reason = 'clean' THEN 'allow' ELSE 'block' END AS action,
      CASE WHEN reason = 'clean' THEN 'logged' ELSE 'blocked' END AS event_action,
      CASE WHEN host = 'chatgpt.com' THEN 'ChatGPT' ELSE 'other' END AS service FROM ({DECIDED_REQUESTS}) d""",
)
def action_of(requests):
    decided = req.action_of(req.inspect_requests(bodies(requests)), {"chatgpt.com": "ChatGPT"})
    return decided.select(
        "id", F.col("body_len").cast("long").alias("body_len"), "action", "event_action", "service"
    )


@CATALOG.add(
    "requests",
    sql="SELECT id, CASE WHEN method = 'CONNECT' THEN 'unsupported_method' END AS guard FROM requests",
)
def request_guard(requests):
    return req.request_guard(bodies(requests)).select("id", "guard")


@CATALOG.add(
    "requests",
    sql="""SELECT id, CASE WHEN content_type NOT LIKE '%latin1' THEN split_part(content_type, ';', 1) END AS kind FROM requests""",
)
def media_type(requests):
    return req.media_type(requests).select("id", F.col("media.kind").alias("kind"))


@CATALOG.add(
    "requests",
    sql="""SELECT id, CASE WHEN path NOT LIKE '%FF' THEN replace(path, '%40', '@') END AS decoded,
      replace(replace(replace(replace(replace(text, '%', '%25'), '&', '%26'), '=', '%3D'), '+', '%2B'), ' ', '+') = '' AS blank FROM requests""",
)
def percent_decode(requests):
    return requests.select(
        "id", T.percent_decode(F.col("path")).alias("decoded"), (F.col("text") == "").alias("blank")
    )


@CATALOG.add(
    "requests",
    sql="""SELECT id, CASE WHEN body_text NOT LIKE '%,' THEN 'role|' || role || '|text|' || text END AS strings
    FROM requests r JOIN (SELECT conv_id, turn, role FROM conversations) c ON c.conv_id = r.conv_id AND c.turn = r.turn
    WHERE content_type = 'application/json'""",
)
def json_strings(requests):
    bodies = requests.filter("content_type = 'application/json'")
    return bodies.select("id", T.json_strings(F.col("body_text")).alias("s")).select(
        "id", F.when(F.col("s").isNotNull(), F.array_join("s", "|")).alias("strings")
    )


@CATALOG.add(
    "requests",
    sql="""SELECT id, 'role|' || role || '|text|' || text AS parts
    FROM requests r JOIN (SELECT conv_id, turn, role FROM conversations) c ON c.conv_id = r.conv_id AND c.turn = r.turn
    WHERE content_type = 'application/x-www-form-urlencoded'""",
)
def form_strings(requests):
    forms = requests.filter("content_type = 'application/x-www-form-urlencoded'")
    parts = T.form_parts(F.col("body_text"), F.lit(False))
    return forms.select("id", F.array_join(parts, "|").alias("parts"))


_TURNS = rules_sql("conversations", "text", "text", "conv_id, turn")
_RANK = """CASE WHEN rules = '' THEN NULL WHEN regexp_matches(rules, 'kr_rrn|credit_card|private_key|anthropic|openai|aws|github') THEN 3
      WHEN regexp_matches(rules, 'slack|google') THEN 2 WHEN rules LIKE '%kr_phone%' THEN 1 ELSE 0 END"""


@CATALOG.add(
    "conversations",
    sql=f"""SELECT conv_id, count(*) AS turns, count(r) AS turns_hit, min(CASE WHEN r IS NOT NULL THEN turn END) AS first_turn,
      CASE max(r) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' WHEN 0 THEN 'low' END AS severity
    FROM (SELECT conv_id, turn, {_RANK} AS r FROM ({_TURNS}) t) x GROUP BY conv_id""",
)
def conversation_scan(conv):
    return req.conversation_scan(conv)


def _observed(pages):
    """Page observations from stored pages: status and host by page, texts from the page."""
    n = F.col("page_id")
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    frames = F.array(
        F.struct(
            F.when(n % 13 == 0, "https://challenges.cloudflare.com/x").otherwise(F.col("url")).alias("url"),
            F.lit("").alias("title"),
        )
    )
    return pages.select(
        F.floor(n / 6).alias("run"),
        n.alias("index"),
        F.when(n % 4 == 0, "auth.openai.com")
        .when(n % 4 == 3, "elsewhere.test")
        .otherwise("chatgpt.com")
        .alias("host"),
        F.when(n % 5 != 0, 200 + 100 * (n % 3)).cast("int").alias("http_status"),
        F.contains("html", F.lit("<nav>")).alias("prompt_box_visible"),
        req.challenge(title, F.col("html"), frames).alias("challenge"),
        (n % 7 == 0).alias("login_required"),
        (n % 3).alias("user_messages"),
        (n % 2).alias("assistant_messages"),
    )


_SEEN = """SELECT page_id, cast(floor(page_id / 6.0) as bigint) AS run,
      CASE page_id % 4 WHEN 0 THEN 'auth.openai.com' WHEN 3 THEN 'elsewhere.test' ELSE 'chatgpt.com' END AS host,
      CASE WHEN page_id % 5 <> 0 THEN cast(200 + 100 * (page_id % 3) as int) END AS http_status, html LIKE '%<nav>%' AS prompt,
      page_id % 13 = 0 OR regexp_matches(lower(html), 'just a moment|verify you are human|checking your browser') AS challenge,
      page_id % 7 = 0 AS login, page_id % 3 AS user_messages FROM pages"""
_STATE = """CASE WHEN challenge THEN 'challenge_stop' WHEN {login} THEN 'login_required' WHEN http_status >= 400 THEN 'http_error'
      WHEN prompt THEN 'prompt_visible' WHEN http_status IS NULL THEN 'unknown' ELSE 'page_unavailable' END"""


@CATALOG.add(
    "pages", sql=f"SELECT page_id AS index, {_STATE.format(login='login')} AS result FROM ({_SEEN}) s"
)
def page_state(pages):
    return req.page_state(_observed(pages)).select("index", "result")


_LOGIN = "(login OR host = 'auth.openai.com')"


@CATALOG.add(
    "pages",
    sql=f"""WITH s AS (SELECT *, {_STATE.format(login=_LOGIN)} AS result FROM ({_SEEN}) x),
    e AS (SELECT *, CASE result WHEN 'prompt_visible' THEN 0 WHEN 'challenge_stop' THEN 1 WHEN 'login_required' THEN 2 WHEN 'http_error' THEN 3
        WHEN 'page_unavailable' THEN 4 ELSE 5 END AS p FROM s WHERE host <> 'elsewhere.test'),
    runs AS (SELECT DISTINCT run FROM s),
    c AS (SELECT run, count_if(p = 0) AS clean FROM e GROUP BY run),
    b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY p, page_id) = 1)
    SELECT runs.run, CASE WHEN clean > 1 THEN 'ambiguous_tabs' WHEN clean IS NULL THEN 'page_unavailable' ELSE b.result END AS result,
      CASE WHEN clean <= 1 THEN b.page_id END AS selected_index, CASE WHEN clean <= 1 THEN b.http_status END AS http_status,
      CASE WHEN clean <= 1 THEN b.user_messages END AS user_messages
    FROM runs LEFT JOIN c ON c.run = runs.run LEFT JOIN b ON b.run = runs.run""",
)
def select_observation(pages):
    return req.select_observation(_observed(pages)).select(
        "run", "result", "selected_index", "http_status", "user_messages"
    )


@CATALOG.add(
    "documents",
    sql="""SELECT doc_id, CASE WHEN (doc_id % 4 >= 2 AND length(text) > 131072) OR ((doc_id % 4 >= 2 OR contains(text, chr(34)))
        AND list_max(list_transform(string_split_regex(text, CASE WHEN doc_id % 2 = 0 THEN '[,\\n\\r]' ELSE '[\\t\\n\\r]' END), lambda f: length(f))) > 131072)
      THEN NULL ELSE CASE WHEN doc_id % 4 >= 2 THEN text || ' | ' ELSE '' END
      || replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), CASE WHEN doc_id % 2 = 0 THEN ',' ELSE chr(9) END, ' | ') END AS text
    FROM documents""",
)
def delimited_to_text(docs):
    """Each text as a table of its own: fields that hold quotes are quoted, with the quotes doubled.

    Half of the tables begin with the whole text once more, as one quoted field of many lines.
    A table with quotes and a field beyond the reader's limit has no text.
    """
    csv = F.col("doc_id") % 2 == 0
    mark = F.when(csv, ",").otherwise("\t")
    doubled = F.replace("text", F.lit('"'), F.lit('""'))
    fields = lambda m: F.regexp_replace(doubled, f'(?<![^{m}\n\r])([^{m}\n\r"]*+"[^{m}\n\r]*+)', '"$1"')
    table = F.when(csv, fields(",")).otherwise(fields("\t"))
    first = F.when(F.col("doc_id") % 4 >= 2, F.concat(F.lit('"'), doubled, F.lit('"'), mark)).otherwise("")
    files = docs.select(
        "doc_id", F.when(csv, "csv").otherwise("tsv").alias("format"), F.concat(first, table).alias("text")
    )
    return readers.delimited_to_text(files).select("doc_id", "text")


@CATALOG.add(
    "documents",
    sql="""WITH lines AS (SELECT source, lang, doc_id, unnest(string_split(text, chr(10))) AS value FROM documents),
    s AS (SELECT source, lang, max(doc_id) AS r, count(*) AS cells, sum(length(value)) AS chars FROM lines GROUP BY ALL)
    SELECT source AS path, cast(max(r) as bigint) AS rows, cast(sum(cells) as bigint) AS cells, cast(sum(chars) as bigint) AS chars,
      CASE WHEN max(r) > 10000 THEN 'spreadsheet_row_limit' WHEN sum(cells) > 50000 THEN 'spreadsheet_cell_limit'
           WHEN sum(chars) > 60000 THEN 'extracted_text_limit' END AS error FROM s GROUP BY source""",
)
def sheet_cell_guard(docs):
    cells = docs.select(
        F.col("source").alias("path"),
        F.col("lang").alias("sheet"),
        F.col("doc_id").alias("row"),
        F.explode(F.split("text", "\n")).alias("value"),
    )
    return readers.table_guard(cells)
