"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import templates
from loam.functions import text as X
from loam.operators import chunk, dedup, embedding, html, messages, profile, quality, scratch, sets, split, vector
from loam.plans import pipelines
from loam.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def turns(s: SparkSession, d: str) -> DataFrame:
    return messages.collect_turns(s.read.parquet(f"{d}/conversations.parquet"))


def pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet")


STRIP = r"'^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP})"


def sql_squeeze(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '[\s\x0b\x1c-\x1f]+', ' ', 'g')")


def sql_clean(x: str) -> str:
    for pattern, to in ((r'^id="[^"]*"\s*', ""), (r"^>\s*", ""), (" ", " "), (r"[ \t]+", " "), (r"\n+", " "), (" +", " "), (r"(?i)\bundefined\b", ""), (r"(?i)\bnull\b", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return sql_strip(x)


CONV = "conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"
CLEAN = f"cleaned AS (SELECT conv_id, list_filter(list_transform(m, lambda x: {{'role': x.role, 'content': {sql_clean('x.content')}}}), lambda x: x.content <> '') AS m FROM conv)"


def sql_last(role: str, m: str = "m") -> str:
    return f"list_filter({m}, lambda x: x.role = '{role}')[-1].content"


def sql_rendered(m: str = "m") -> str:
    return f"array_to_string(list_transform({m}, lambda x: x.role || ':' || x.content), '|')"


def sql_runs(x: str) -> str:
    return rf"(length({x}) >= 10 AND len(list_filter(range(1, length({x}) - 4), lambda i: {x}[i:i] NOT IN (' ', chr(10), chr(9)) AND {x}[i:i+4] = repeat({x}[i:i], 5))) > 0)"


def sql_truncated(x: str) -> str:
    t = sql_strip(x)
    return rf"CASE WHEN length({t}) = 0 THEN true WHEN length({t}) < 100 THEN false ELSE NOT (regexp_matches(right({t}, 1), '[.!?;)\]}}\x22]') OR regexp_matches(right({t}, 30), '[.!?;]')) END"


U, A = "coalesce(u, '')", "coalesce(a, '')"
REASON = f"""reasons AS (SELECT conv_id, m, CASE WHEN len(m) < 2 THEN 'empty_after_cleaning' WHEN length({sql_strip(U)}) < 5 THEN 'user_too_short' WHEN length({sql_strip(A)}) < 10 THEN 'assistant_too_short'
    WHEN length({U}) + length({A}) > 50000 THEN 'too_long' WHEN {sql_runs(U)} OR {sql_runs(A)} THEN 'repetitive_chars' WHEN length({A}) > 100 AND {sql_truncated(A)} THEN 'truncated' END AS reason
    FROM (SELECT conv_id, m, {sql_last('user')} AS u, {sql_last('assistant')} AS a FROM cleaned))"""
DUPS = f"""tagged AS (SELECT conv_id, m, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY reason IS NULL, {sql_rendered()} ORDER BY conv_id) > 1 THEN 'exact_duplicate' END AS reason FROM reasons)"""
BASE = f"WITH {CONV}, {CLEAN}, {REASON}, {DUPS} "


def tagged(s: SparkSession, d: str) -> DataFrame:
    rows = turns(s, d).withColumn("messages", messages.clean_messages(F.col("messages")))
    rows = rows.withColumn("reason", F.when(F.size("messages") < 2, "empty_after_cleaning").otherwise(quality.reason(F.col("messages"))))
    rows = scratch.written(rows)  # else the optimizer puts cleaning and tests into each use of their results
    once = dedup.exact(rows, messages.rendered(F.col("messages")), "conv_id", F.col("reason").isNull())
    return once.withColumn("reason", F.coalesce("reason", F.when(F.col("is_dup"), "exact_duplicate"))).drop("is_dup")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Conversations that survive cleaning, filters and exact dedup."""
    m = F.col("messages")
    return tagged(s, d).filter("reason is null").select("conv_id", F.size(m).alias("n_messages"), messages.last_of(m, "user").alias("user_text"), messages.last_of(m, "assistant").alias("assistant_text"))


@query(BASE + f"SELECT conv_id, len(m)::INTEGER AS n_messages, {sql_last('user')} AS user_text, {sql_last('assistant')} AS assistant_text FROM tagged WHERE reason IS NULL")
def survivors(s, d):
    return flagship(s, d)


@query(f"WITH {CONV} SELECT conv_id, len(m)::INTEGER AS n, {sql_rendered()} AS rendered FROM conv")
def messages_collect(s, d):
    return turns(s, d).select("conv_id", F.size("messages").alias("n"), messages.rendered(F.col("messages")).alias("rendered"))


@query(f"WITH {CONV} SELECT conv_id, {sql_last('user')} AS user_text, {sql_last('assistant')} AS assistant_text FROM conv")
def last_user_assistant(s, d):
    m = F.col("messages")
    return turns(s, d).select("conv_id", messages.last_of(m, "user").alias("user_text"), messages.last_of(m, "assistant").alias("assistant_text"))


@query(f"""WITH {CONV}, sides AS (SELECT conv_id, {sql_strip("CASE WHEN conv_id % 7 = 3 THEN ' ' ELSE coalesce(" + sql_last('user') + ", '') END")} AS u, {sql_strip("CASE WHEN conv_id % 7 > 4 THEN '' ELSE coalesce(" + sql_last('assistant') + ", '') END")} AS a FROM conv)
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND (u = '' OR a = '') THEN 'empty_after_normalization' END AS reason, 'system:{messages.SYSTEM}|user:' || CASE WHEN u = '' THEN '{messages.QUESTION}' ELSE u END || '|assistant:' || a AS rendered FROM sides""")
def chatml_normalize(s, d):
    m, k = F.col("messages"), F.col("conv_id") % 7
    asked, answer = F.when(k == 3, " ").otherwise(messages.last_of(m, "user")), F.when(k > 4, "").otherwise(messages.last_of(m, "assistant"))
    rows = turns(s, d).select("conv_id", asked.alias("raw_case"), answer.alias("raw_article"), (F.col("conv_id") % 2 == 0).alias("is_messages_format"))
    return messages.chatml(rows).select("conv_id", "reason", messages.rendered(F.col("messages")).alias("rendered"))


@query(f"WITH {CONV}, {CLEAN} SELECT conv_id, {sql_rendered()} AS rendered, len(m) >= 2 AS kept FROM cleaned")
def clean_messages(s, d):
    m = messages.clean_messages(F.col("messages"))
    return turns(s, d).select("conv_id", messages.rendered(m).alias("rendered"), (F.size(m) >= 2).alias("kept"))


@query(BASE + "SELECT conv_id, reason FROM tagged")
def quality_reason(s, d):
    return tagged(s, d).select("conv_id", "reason")


#: Conversations from documents that fail each of the tests, some two of them.
MADE_USER = "CASE WHEN doc_id % 11 IN (0, 6) THEN ' ab ' ELSE 'Вопрос ' || doc_id END"
MADE_ANSWER = "CASE doc_id % 11 WHEN 1 THEN 'Коротко' WHEN 2 THEN repeat(text || ' ab. ', 1 + 50000 // greatest(length(text), 1)) WHEN 3 THEN text || ' !!!!!! конец.' WHEN 4 THEN text || repeat(' слово', 20) WHEN 5 THEN ' undefined ' WHEN 6 THEN 'да' WHEN 7 THEN 'Ответ дан. ' || repeat('ab', 30) || ' всё, кроме zzzzz' ELSE text || ' Конец.' END"
MADE = f"conv AS (SELECT doc_id AS conv_id, [{{'role': 'user', 'content': {MADE_USER}}}, {{'role': 'assistant', 'content': {MADE_ANSWER}}}] AS m FROM documents)"


def made_tagged(s: SparkSession, d: str) -> DataFrame:
    i, k, t = F.col("doc_id").cast("string"), F.col("doc_id") % 11, F.col("text")
    times = (F.lit(1) + F.floor(F.lit(50_000) / F.greatest(F.length(t), F.lit(1)))).cast("int")
    answer = (
        F.when(k == 1, "Коротко").when(k == 2, F.repeat(F.concat(t, F.lit(" ab. ")), times)).when(k == 3, F.concat(t, F.lit(" !!!!!! конец."))).when(k == 4, F.concat(t, F.lit(" слово" * 20)))
        .when(k == 5, " undefined ").when(k == 6, "да").when(k == 7, "Ответ дан. " + "ab" * 30 + " всё, кроме zzzzz").otherwise(F.concat(t, F.lit(" Конец.")))
    )
    asked = F.when(k.isin(0, 6), " ab ").otherwise(F.concat(F.lit("Вопрос "), i))
    rows = docs(s, d).select("doc_id", messages.clean_messages(F.array(messages.message("user", asked), messages.message("assistant", answer))).alias("messages"))
    reason = F.when(F.size("messages") < 2, "empty_after_cleaning").otherwise(quality.reason(F.col("messages")))
    rows = scratch.written(rows.withColumn("reason", reason))
    once = dedup.exact(rows, messages.rendered(F.col("messages")), "doc_id", F.col("reason").isNull())
    return once.withColumn("reason", F.coalesce("reason", F.when(F.col("is_dup"), "exact_duplicate"))).drop("is_dup")


@query(f"WITH {MADE}, {CLEAN}, {REASON} SELECT conv_id AS doc_id, reason FROM reasons")
def quality_each_reason(s, d):
    return made_tagged(s, d).select("doc_id", F.when(F.col("reason") != "exact_duplicate", F.col("reason")).alias("reason"))


@query(f"WITH {MADE}, {CLEAN}, {REASON}, {DUPS} SELECT reason, count(*) AS n FROM tagged WHERE reason IS NOT NULL GROUP BY reason")
def reason_histogram(s, d):
    return profile.reason_histogram(made_tagged(s, d))


@query(BASE + """SELECT count(*) AS initial_count, count(*) AS after_normalization, count(*) FILTER (reason IS NULL OR reason <> 'empty_after_cleaning') AS after_cleaning,
    count(*) FILTER (reason IS NULL OR reason = 'exact_duplicate') AS after_filtering, count(*) FILTER (reason IS NULL) AS after_dedup, count(*) - count(*) FILTER (reason IS NULL) AS total_removed,
    (count(*) - count(*) FILTER (reason IS NULL))::DOUBLE / count(*) AS removal_rate FROM tagged""")
def stage_report(s, d):
    return profile.stage_report(tagged(s, d))


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_dup FROM documents")
def exact_dedup(s, d):
    return dedup.exact(docs(s, d).select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "is_dup")


LOADED = f"""kept AS (SELECT conv_id, list_filter(list_transform(m, lambda x: {{'role': {sql_strip('x.role')}, 'content': {sql_strip('x.content')}}}), lambda x: x.role <> '' AND x.content <> '') AS m FROM conv),
    loaded AS (SELECT conv_id, CASE WHEN len(m) > 0 AND m[-1].role = 'assistant' AND len(list_filter(m, lambda x: x.role = 'user')) > 0 THEN m END AS m FROM kept)"""


@query(f"WITH {CONV}, {LOADED} SELECT conv_id, {sql_rendered()} AS rendered FROM loaded")
def loader_normalize(s, d):
    return turns(s, d).select("conv_id", messages.rendered(messages.loader_messages(F.col("messages"))).alias("rendered"))


@query(f"""SELECT doc_id, coalesce(CASE WHEN i <> '' AND n <> '' THEN i || chr(10) || chr(10) || n END, nullif(c, ''), nullif(n, ''), nullif(i, ''), '') AS user_text, md5(coalesce(nullif(t, ''), '')) AS answer
    FROM (SELECT doc_id, {sql_strip("coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, '')")} AS c, {sql_strip("coalesce(CASE WHEN quality = 1 THEN source END, '')")} AS i, {sql_strip("coalesce(CASE WHEN toxic = 0 THEN text END, '')")} AS n, {sql_strip("text")} AS t FROM documents LEFT JOIN labels USING (doc_id))""")
def legacy_coalesce(s, d):
    rows = docs(s, d).join(s.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    rows = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("case"), F.when(F.col("quality") == 1, F.col("source")).alias("instruction"), F.when(F.col("toxic") == 0, F.col("text")).alias("input"), F.col("text").alias("answer"))
    user, answer = messages.legacy_pair(rows)
    return rows.select("doc_id", user.alias("user_text"), F.md5(answer.cast("binary")).alias("answer"))


@query(f"""WITH {CONV}, parts AS (SELECT conv_id, {sql_strip("coalesce(array_to_string(list_transform(list_filter(m, lambda x: x.role = 'system' AND x.content <> ''), lambda x: x.content), chr(10) || chr(10)), '')")} AS sys,
    coalesce(list_filter(m, lambda x: x.role = 'user' AND x.content <> '')[-1].content, '') AS u, coalesce(list_filter(m, lambda x: x.role = 'assistant' AND x.content <> '')[-1].content, '') AS a FROM conv)
    SELECT conv_id, '<s>[INST] ' || CASE WHEN sys <> '' AND u <> '' THEN sys || chr(10) || chr(10) || u ELSE u END || ' [/INST] ' || a || '</s>' AS inst FROM parts""")
def inst_render(s, d):
    return turns(s, d).select("conv_id", messages.inst_text(F.col("messages")).alias("inst"))


@query(f"WITH {CONV} SELECT conv_id, array_to_string(list_transform(m, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '') AS rendered FROM conv")
def chat_render(s, d):
    return turns(s, d).select("conv_id", messages.chat_text(F.col("messages")).alias("rendered"))


HEADERS = """{%- for message in messages %}
    {%- set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\n\n' + message['content'] | trim + '<|eot_id|>' %}
    {%- if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}
    {{- content }}
{%- endfor %}
{%- if messages[-1]['role'] != 'assistant' %}{{- raise_exception('no answer') if strict else '...' }}{% endif %}
"""


@query(f"""WITH {CONV} SELECT conv_id, '<s>' || array_to_string(list_transform(m, lambda x: '<|start_header_id|>' || x.role || '<|end_header_id|>' || chr(10) || chr(10) || {sql_strip('x.content')} || '<|eot_id|>'), '')
    || CASE WHEN m[-1].role <> 'assistant' THEN '...' ELSE '' END AS rendered FROM conv""")
def template_render(s, d):
    """Conversations in the form of a tokenizer's own template."""
    return turns(s, d).select("conv_id", templates.render(HEADERS, F.col("messages"), bos_token="<s>", strict=False).alias("rendered"))


@query("""SELECT doc_id, doc_id % 8 IN (0, 1, 2, 3) AS inference_only FROM documents""")
def inference_only_names(s, d):
    k, i = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit(" Org/Model-"), i, F.lit(".Q4.GGUF "))).when(k == 1, F.concat(F.lit("org/m"), i, F.lit("_gguf"))).when(k == 2, F.concat(F.lit("gguf/m"), i)).when(k == 3, F.concat(F.lit("a-GGUF-"), i))
        .when(k == 4, F.concat(F.lit("org/ggufmodel"), i)).when(k == 5, F.concat(F.lit("mygguf"), i, F.lit(".safetensors"))).when(k == 6, F.concat(F.lit(".gguf.old"), i))
    )
    return docs(s, d).select("doc_id", quality.inference_only(name).alias("inference_only"))


@query(f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned FROM documents")
def clean_text(s, d):
    return docs(s, d).select("doc_id", F.md5(X.clean_chat(F.col("text")).cast("binary")).alias("cleaned"))


@query("SELECT doc_id, md5(" + sql_squeeze(r"regexp_replace(regexp_replace(regexp_replace(text || ' (В редакции от 1) x', '\(В редакции[^\n]*?\)', '', 'g'), '\(Дополнение[^\n]*?\)', '', 'g'), '\(Утратила силу[^\n]*?\)', '', 'g')") + ") AS cleaned FROM documents")
def clean_text_qa(s, d):
    return docs(s, d).select("doc_id", F.md5(X.clean_article(F.concat("text", F.lit(" (В редакции от 1) x"))).cast("binary")).alias("cleaned"))


@query(f"SELECT doc_id, md5({sql_squeeze('text')}) AS cleaned FROM documents")
def clean_text_ws(s, d):
    return docs(s, d).select("doc_id", F.md5(X.squeeze(F.col("text")).cast("binary")).alias("cleaned"))


HEADED = "CASE WHEN doc_id % 4 = 0 THEN 'Статья ' || doc_id || ' ' || (doc_id % 7) || '. ' WHEN doc_id % 4 = 1 THEN 'СТАТЬЯ ' || doc_id || '.3 ' WHEN doc_id % 4 = 2 THEN 'Статья ' || doc_id || '.5 ' ELSE '' END || text"


def headed() -> F.Column:
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    head = F.when(m == 0, F.concat(F.lit("Статья "), i, F.lit(" "), (F.col("doc_id") % 7).cast("string"), F.lit(". "))).when(m == 1, F.concat(F.lit("СТАТЬЯ "), i, F.lit(".3 "))).when(m == 2, F.concat(F.lit("Статья "), i, F.lit(".5 "))).otherwise("")
    return F.concat(head, "text")


@query(rf"SELECT doc_id, coalesce(nullif(replace(regexp_extract({HEADED}, '(?i)Статья\s+(\d+(?:\s+\d+)?)', 1), ' ', '_'), ''), 'unknown') AS number FROM documents")
def article_number(s, d):
    return docs(s, d).select("doc_id", X.article_number(headed()).alias("number"))


@query(rf"SELECT doc_id, nullif(regexp_extract({HEADED}, 'Статья\s+(\d+(?:\.\d+)*)', 1), '') AS number FROM documents")
def article_number_dotted(s, d):
    return docs(s, d).select("doc_id", X.dotted_number(headed()).alias("number"))


TITLED = f"titled AS (SELECT doc_id, {sql_squeeze(HEADED)} AS c, {sql_squeeze('text')} AS t FROM documents)"


@query(rf"""WITH {TITLED}, parts AS (SELECT doc_id, c, t, regexp_matches(c, '^Статья\s+([\d½\-\s]+)\.?\s*([^\n]+)') AS ok, regexp_extract(c, '^Статья\s+([\d½\-\s]+)\.?\s*([^\n]+)', 1) AS n, regexp_extract(c, '^Статья\s+([\d½\-\s]+)\.?\s*([^\n]+)', 2) AS h FROM titled),
    named AS (SELECT doc_id, c, t, CASE WHEN ok THEN {sql_strip('n')} ELSE 'неизвестная' END AS n, CASE WHEN ok THEN {sql_strip('h')} ELSE c END AS h, {sql_strip("substring(t, length(c) + 1)")} AS rest FROM parts),
    bodies AS (SELECT doc_id, n, h, CASE WHEN starts_with(t, c) THEN CASE WHEN starts_with(rest, '. ') THEN {sql_strip("substring(rest, 3)")} ELSE rest END ELSE t END AS b FROM named)
    SELECT doc_id, 'Какая статья из ТК регулирует: ' || array_to_string(list_filter(string_split_regex(h, '\s+'), lambda w: w <> '')[1:6], ' ') AS question,
    md5('Статья ' || n || '. ' || h || CASE WHEN b <> '' AND {sql_strip('b')} <> {sql_strip('h')} THEN ' ' || b ELSE '' END) AS answer FROM bodies WHERE h <> ''""")
def title_parse_qa(s, d):
    rows = docs(s, d).select("doc_id", headed().alias("title"), F.col("text").alias("content"))
    return messages.qa_pair(rows, F.lit("ТК")).select("doc_id", "question", F.md5(F.col("answer").cast("binary")).alias("answer"))


@query(rf"""WITH n AS (SELECT doc_id, upper(lang) AS code, {HEADED} AS title, coalesce(nullif(replace(regexp_extract(CASE WHEN doc_id % 2 = 0 THEN {HEADED} ELSE text END, '(?i)Статья\s+(\d+(?:\s+\d+)?)', 1), ' ', '_'), ''), 'unknown') AS number FROM documents),
    named AS (SELECT *, {sql_strip("replace(" + sql_strip("replace(" + sql_strip("replace(title, 'Статья ' || number, '')") + ", 'ст. ' || number, '')") + ", 'Статья ' || replace(number, '_', ' '), '')")} AS name FROM n)
    SELECT doc_id, number, CASE WHEN number <> 'unknown' THEN md5('Какая статья из ' || code || ' кодекс РФ регулирует: ' || coalesce(nullif(name, ''), title)) WHEN title <> '' THEN md5('Расскажи о статье: ' || title) ELSE md5('Расскажи об этой статье ' || code || ' кодекса') END AS question FROM named""")
def question_synthesis(s, d):
    rows = docs(s, d).select("doc_id", "lang", headed().alias("title"), F.when(F.col("doc_id") % 2 == 0, headed()).otherwise(F.col("text")).alias("content"))
    number, asked = messages.question_of(F.col("lang"), F.col("title"), F.col("content"))
    return rows.select("doc_id", number.alias("number"), F.md5(asked.cast("binary")).alias("question"))


LAWFUL = "CASE doc_id % 5 WHEN 0 THEN 'Статья ' || doc_id || ' ГК РФ' WHEN 1 THEN 'статья ' || doc_id || ' тк' WHEN 2 THEN 'Статья 1 КоАП' WHEN 3 THEN 'Статья ' || doc_id || '. Понятие' ELSE text END"
LAW_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LAWS.items())


@query(rf"""SELECT doc_id, coalesce(code, 'UNKNOWN') AS law_code, CASE WHEN code IS NULL THEN 'Неизвестно' ELSE CASE code {LAW_CASE} ELSE 'Другой закон' END END AS law
    FROM (SELECT doc_id, coalesce(nullif(upper(regexp_extract({LAWFUL}, '(?i)^Статья\s+\d+\s+([А-ЯA-Z]+)', 1)), ''), nullif(upper(regexp_extract('Статья 9 УК', '(?i)^Статья\s+\d+\s+([А-ЯA-Z]+)', 1)), '')) AS code, doc_id % 5 AS k FROM documents) WHERE k <> 4
    UNION ALL SELECT doc_id, 'UNKNOWN', 'Неизвестно' FROM documents WHERE doc_id % 5 = 4""")
def law_label(s, d):
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    article = F.when(m == 0, F.concat(F.lit("Статья "), i, F.lit(" ГК РФ"))).when(m == 1, F.concat(F.lit("статья "), i, F.lit(" тк"))).when(m == 2, "Статья 1 КоАП").when(m == 3, F.concat(F.lit("Статья "), i, F.lit(". Понятие"))).otherwise(F.col("text"))
    name, code = X.law(article, F.when(m == 4, "").otherwise("Статья 9 УК"))
    return docs(s, d).select("doc_id", code.alias("law_code"), name.alias("law"))


@query(f"SELECT conv_id, turn, {sql_runs('text')} AS repetitive FROM conversations")
def repetitive_chars(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.repetitive(F.col("text")).alias("repetitive"))


@query(f"SELECT doc_id, {sql_truncated('text')} AS truncated FROM documents")
def truncated(s, d):
    return docs(s, d).select("doc_id", X.truncated(F.col("text")).alias("truncated"))


@query("SELECT page_id, regexp_matches(html, '(?i)" + "|".join(X.NOISE) + "') AS html_noise, regexp_matches(url, '(?i)" + "|".join(X.NOISE) + "') AS url_noise FROM pages")
def noise_flag(s, d):
    return pages(s, d).select("page_id", X.noisy(F.col("html")).alias("html_noise"), X.noisy(F.col("url")).alias("url_noise"))


SETS = r"sets AS (SELECT w, min(doc_id) AS lead FROM (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(left(text, 500)), '[\s\x0b\x1c-\x1f]+'), lambda x: x <> ''))) AS w FROM documents) GROUP BY w)"


PAIRS = f"""{SETS}, sized AS (SELECT lead, w, len(w) AS n FROM sets WHERE len(w) >= 20), both_ AS (SELECT a.lead AS a, b.lead AS b, a.n AS na, b.n AS nb, len(list_intersect(a.w, b.w)) AS k FROM sized a JOIN sized b ON a.lead < b.lead AND 20 * least(a.n, b.n) > 19 * greatest(a.n, b.n)),
    pairs AS (SELECT a, b, k::DOUBLE / (na + nb - k) AS similarity FROM both_ WHERE 20 * k > 19 * (na + nb - k))"""


@query(f"WITH {PAIRS} SELECT a, b, similarity FROM pairs")
def near_dup_pairs(s, d):
    return dedup.near_pairs(docs(s, d), F.lower(F.left("text", F.lit(500))), "doc_id")


@query(rf"""WITH RECURSIVE {PAIRS}, waiting AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
    walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT n.i, CASE WHEN len(list_filter(n.earlier, lambda x: NOT list_contains(walk.gone, x))) > 0 THEN list_append(walk.gone, n.b) ELSE walk.gone END FROM walk JOIN waiting n ON n.i = walk.i + 1),
    decided AS (SELECT unnest(arg_max(gone, i)) AS lead FROM walk),
    own AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(left(text, 500)), '[\s\x0b\x1c-\x1f]+'), lambda x: x <> ''))) AS w FROM documents)
    SELECT doc_id, len(own.w) > 0 AND (doc_id > lead OR lead IN (SELECT lead FROM decided)) AS is_dup FROM own JOIN sets USING (w)""")
def near_dedup(s, d):
    return dedup.near(docs(s, d).select("doc_id", "text"), F.lower(F.left("text", F.lit(500))), "doc_id").select("doc_id", "is_dup")


@query("SELECT lang, split_part(text, ' ', 1) AS head, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text)) AS n, min(doc_id) AS first_seen FROM documents GROUP BY ALL")
def argmax_dedupe(s, d):
    rows = docs(s, d).select("lang", F.split_part("text", F.lit(" "), F.lit(1)).alias("head"), "text", "doc_id")
    return dedup.longest(rows, ["lang", "head"], "text", "doc_id").select("lang", "head", "doc_id", F.length("text").cast("long").alias("n"), "first_seen")


@query("SELECT split_part(url, '/', 3) AS host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
def keep_first_uniq(s, d):
    rows = pages(s, d).select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "page_id", "url")
    return dedup.keep_first(rows, ["host"], "page_id")


NOISY_SQL = "len(list_filter(m, lambda x: regexp_matches(x.content, '(?i)" + "|".join(X.NOISE) + "'))) > 0"


@query(f"""WITH {CONV}, h AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, conv_id % 5 = 0 AS bad, CASE WHEN conv_id % 5 <> 0 THEN md5({sql_rendered()}) END AS h, conv_id % 5 <> 0 AND {NOISY_SQL} AS noisy FROM conv)
    SELECT dataset, count(*)::BIGINT AS total_records, count(DISTINCT h) AS valid_records, count(*) FILTER (bad) AS bad_format, count(*) FILTER (noisy) AS noise_count, count(h) - count(DISTINCT h) AS internal_duplicates FROM h GROUP BY dataset""")
def health_counts(s, d):
    rows = turns(s, d).withColumn("messages", F.when(F.col("conv_id") % 10 == 0, F.array().cast(messages.MESSAGES)).when(F.col("conv_id") % 5 != 0, F.col("messages")))
    return profile.health(rows, F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))


@query("SELECT role, min(length(text))::INTEGER AS min_len, max(length(text))::INTEGER AS max_len, trunc(median(length(text)))::INTEGER AS median_len, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY role")
def role_length_stats(s, d):
    return profile.role_lengths(turns(s, d))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0 AND md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 10 <> 0 UNION SELECT md5(text) FROM benchmark)")
def leakage(s, d):
    rows = docs(s, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    test = rows.filter("doc_id % 10 = 0")
    bench = s.read.parquet(f"{d}/benchmark.parquet").select(F.md5(F.col("text").cast("binary")).alias("h"))
    return profile.leaked(test, rows.filter("doc_id % 10 <> 0").select("h").unionByName(bench)).select("doc_id")


@query(f"WITH {CONV} SELECT round_even(avg(length(m[-1].content)), 0) AS avg_len, min(length(m[-1].content))::INTEGER AS min_len, max(length(m[-1].content))::INTEGER AS max_len, count(*) AS n FROM conv")
def length_stats(s, d):
    return profile.length_stats(turns(s, d))


@query(f"WITH {CONV} SELECT conv_id FROM conv WHERE conv_id % 4 = 0 ORDER BY conv_id LIMIT 10")
def issues_sample(s, d):
    rows = turns(s, d).withColumn("messages", F.when(F.col("conv_id") % 4 != 0, F.col("messages")))
    return profile.issues(rows, "conv_id")


def sql_rank(key: str, of: str) -> str:
    return f"(SELECT {key}, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) AS r, count(*) OVER () AS n FROM {of})"


SIMPLE = f"""parts AS (SELECT source, CASE WHEN r <= trunc(n * 0.8::DOUBLE) THEN 'train' WHEN r <= trunc(n * 0.8::DOUBLE) + trunc(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM {sql_rank('source', '(SELECT DISTINCT source FROM documents)')})"""


@query(f"WITH {SIMPLE} SELECT doc_id, source, split FROM documents JOIN parts USING (source)")
def split_simple(s, d):
    return split.simple(docs(s, d).select("doc_id", "source"), "source")


@query(f"SELECT doc_id, CASE WHEN r <= greatest(1, trunc(n * 0.1::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM {sql_rank('doc_id', 'documents')}")
def split_rows(s, d):
    return split.rows(docs(s, d).select("doc_id"), "doc_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= least(greatest(4, trunc(count(*) OVER () * 0.05::DOUBLE)), count(*) OVER () - 4) THEN 'valid' ELSE 'train' END AS split FROM documents")
def split_tail(s, d):
    return split.tail(docs(s, d).select("doc_id"), "doc_id")


def by_group(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", "lang", F.concat_ws("_", "lang", "source").alias("group_id"))


@query("""WITH RECURSIVE g AS (SELECT lang || '_' || source AS group_id, arg_min(lang, doc_id) AS code FROM documents GROUP BY 1),
    q AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) AS r, count(*) OVER () AS n FROM g),
    goals AS (SELECT n, tr, (n - tr) // 2 AS va, n - tr - (n - tr) // 2 AS te FROM (SELECT max(n) AS n, trunc(max(n) * 0.8::DOUBLE)::BIGINT AS tr FROM q)),
    deal(r, tr, va, te, codes, split) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, MAP([''], [[0::BIGINT, 0::BIGINT, 0::BIGINT]]), ''
        UNION ALL SELECT q.r, o.tr + (x = 'train')::INT, o.va + (x = 'val')::INT, o.te + (x = 'test')::INT,
            map_concat(codes, MAP([q.code], [[c[1] + 1, c[2] + (x = 'train')::INT, c[3] + (x = 'val')::INT]])), x
        FROM (SELECT d.*, q.code, q.r AS at, CASE WHEN d.tr < goals.tr AND (c[2] < 0.8::DOUBLE * c[1] OR c[1] = 0 OR d.va >= goals.va AND d.te >= goals.te) THEN 'train'
            WHEN d.va < goals.va AND (c[3] < 0.1::DOUBLE * c[1] OR c[1] = 0 OR d.te >= goals.te) THEN 'val' ELSE 'test' END AS x, c
            FROM (SELECT d.*, coalesce(codes[q.code], [0, 0, 0]) AS c FROM deal d JOIN q ON q.r = d.r + 1) d JOIN q ON q.r = d.r + 1, goals) o JOIN q ON q.r = o.at),
    last AS (SELECT q.group_id, d.r, d.split, row_number() OVER (PARTITION BY d.split ORDER BY d.r) AS k FROM deal d JOIN q USING (r)),
    sums AS (SELECT count(*) FILTER (split = 'val') AS v, count(*) FILTER (split = 'test') AS t FROM last),
    parts AS (SELECT group_id, CASE WHEN abs(v - t) <= 2 THEN split WHEN v > t AND split = 'val' AND k <= v - (v + t) // 2 THEN 'test' WHEN t > v AND split = 'test' AND k <= (v + t) // 2 - v THEN 'val' ELSE split END AS split FROM last, sums)
    SELECT doc_id, group_id, split FROM (SELECT doc_id, lang || '_' || source AS group_id FROM documents) JOIN parts USING (group_id)""")
def split_stratified(s, d):
    return split.stratified(by_group(s, d), "group_id", "lang", "doc_id").select("doc_id", "group_id", "split")


@query(f"WITH {SIMPLE} SELECT split, source AS group_id FROM parts")
def split_manifest(s, d):
    return split.manifest(split.simple(docs(s, d).select("doc_id", "source"), "source"), "source").withColumnRenamed("group", "group_id")


@query(f"WITH {SIMPLE} SELECT source, count(DISTINCT CASE WHEN doc_id % 97 = 0 THEN 'val' ELSE split END) AS n_splits FROM documents JOIN parts USING (source) GROUP BY source HAVING n_splits > 1")
def split_overlaps(s, d):
    """Groups that rows which were moved to another part leave in two."""
    parts = split.simple(docs(s, d).select("doc_id", "source"), "source")
    return split.overlapping(parts.withColumn("split", F.when(F.col("doc_id") % 97 == 0, "val").otherwise(F.col("split"))), "source")


@query("SELECT count(*) AS n_groups, 0::BIGINT AS n_shared FROM (SELECT DISTINCT source FROM documents)")
def split_disjoint(s, d):
    parts = split.simple(docs(s, d).select("doc_id", "source"), "source")
    shared = split.overlapping(parts, "source").agg(F.count(F.lit(1)).alias("n_shared"))
    return parts.select("source").distinct().agg(F.count(F.lit(1)).alias("n_groups")).join(F.broadcast(shared))


CHUNKS = f"chunks AS (SELECT doc_id, unnest(range(CASE WHEN length(text) > 2500 THEN ceil((length(text) - 400) / 2100.0)::INTEGER ELSE 1 END)) AS chunk_no, text FROM documents WHERE length({sql_strip('text')}) >= 200)"


@query(f"""WITH {CHUNKS} SELECT 'chunk_' || lpad((row_number() OVER (ORDER BY doc_id, chunk_no) - 1)::VARCHAR, 6, '0') AS chunk_id, doc_id, (chunk_no * 2100)::INTEGER AS chunk_start, least(chunk_no * 2100 + 2500, length(text))::INTEGER AS chunk_end, md5(substring(text, chunk_no * 2100 + 1, 2500)) AS document FROM chunks""")
def chunk_documents(s, d):
    rows = chunk.chunk_ids(chunk.chunks(docs(s, d).select("doc_id", "text"), "text"), "doc_id")
    return rows.select("chunk_id", "doc_id", "chunk_start", "chunk_end", F.md5(F.col("document").cast("binary")).alias("document"))


@query("SELECT page_id, CASE WHEN len(string_split(url, '/')) >= 4 THEN upper(split_part(url, '/', 4)) END AS legal_code FROM pages")
def legal_code_url(s, d):
    return chunk.with_code(pages(s, d).select("page_id", "url"), "url").select("page_id", "legal_code")


def sql_knn(where: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(e, embedding::DOUBLE[]) AS d FROM q, embeddings WHERE {where})
    SELECT query_id, vec_id, rank::INTEGER AS rank, round(d + 1e-12, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), vec_id) AS rank FROM p) WHERE rank <= 5"""


def nearest(index: DataFrame, queries: DataFrame) -> DataFrame:
    found = vector.knn(index, queries.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return found.select("query_id", "vec_id", "rank", F.round(F.col("distance") + 1e-12, 6).alias("distance"))


@query(sql_knn("true"))
def vector_topk(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return nearest(e, e)


@query(sql_knn("true"))
def vector_topk_pruned(s, d):
    """The same through cells around pivots."""
    e = s.read.parquet(f"{d}/embeddings.parquet")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn(e, asked, direct=0, components=20_000).select("query_id", "vec_id", "rank", F.round(F.col("distance") + 1e-12, 6).alias("distance"))


@query(sql_knn("label = 3"))
def vector_topk_filtered(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return nearest(e.filter("label = 3"), e)


def sql_unescape(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("nbsp", "\xa0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "\'\'"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


BARE = "bare AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', chr(1), 'g') AS h FROM pages)"


@query(rf"""WITH {BARE} SELECT url, CASE WHEN regexp_matches(h, '(?is)<h1\b') THEN {sql_strip(sql_unescape(r"regexp_replace(regexp_extract(h, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>|' || chr(1), '', 'g')"))} ELSE 'Unknown Title' END AS title,
    md5({sql_strip(sql_unescape("regexp_replace(h, '<[^>]*>|' || chr(1), '', 'g')"))}) AS content FROM bare""")
def parse_pages(s, d):
    return html.parse_pages(pages(s, d), "document").select("url", "title", F.md5(F.col("content").cast("binary")).alias("content"))


@query(rf"""WITH {BARE}, x AS (SELECT url, regexp_extract_all(h, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1) AS hrefs, regexp_extract_all(h, '(?is)<a\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1) AS labels FROM bare),
    y AS (SELECT url, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href, unnest(labels) AS label FROM x)
    SELECT url, pos::INTEGER AS pos, {sql_unescape("href")} AS href, {sql_strip(sql_unescape("regexp_replace(label, '<[^>]*>|' || chr(1), '', 'g')"))} AS label FROM y""")
def page_links(s, d):
    return html.links(pages(s, d))


@query(rf"""WITH {BARE} SELECT page_id, {sql_squeeze("array_to_string(list_filter(list_transform(string_split(" + sql_unescape("regexp_replace(h, '<[^>]*>|' || chr(1), chr(10), 'g')") + ", chr(10)), lambda x: " + sql_strip("x") + "), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{x}'" for x in X.STOP_LINES) + ")), chr(10))")} AS text FROM bare""")
def fragment_to_text(s, d):
    return pages(s, d).select("page_id", html.page_text(F.col("html")).alias("text"))


MARKED = "replace(replace(html, '<h1>', '<h1 id=\"p1\">'), '<article>', '<article id=\"p2\">')"


@query(f"""WITH x AS (SELECT page_id, {MARKED} AS h FROM pages), a AS (SELECT *, instr(h, 'id="p1"') AS s, instr(h, 'id="p2"') AS e FROM x), b AS (SELECT *, CASE WHEN e > 0 THEN instr(substring(h, greatest(e, 1)), '</p>') ELSE 0 END AS z FROM a)
    SELECT page_id, md5(CASE WHEN s > 0 AND e >= s AND z > 0 THEN substring(h, s, e + z + 3 - s) ELSE '' END) AS piece FROM b""")
def anchor_slice(s, d):
    h = F.replace(F.replace("html", F.lit("<h1>"), F.lit('<h1 id="p1">')), F.lit("<article>"), F.lit('<article id="p2">'))
    return pages(s, d).select("page_id", F.md5(html.anchor_slice(h, F.lit("p1"), F.lit("p2")).cast("binary")).alias("piece"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE CASE WHEN doc_id % 3 = 0 THEN 'b,c' ELSE 'c' END END AS ids FROM documents")
def article_nodes(s, d):
    node = lambda i, unit, lvl: F.struct(F.lit(i).alias("id"), unit.alias("unit"), lvl.alias("lvl"))
    k = F.col("doc_id")
    nodes = F.array(node("a", F.when(k % 2 == 0, "статья"), F.lit(1)), node("b", F.when(k % 3 == 0, "Статья 5").otherwise("глава"), F.lit(2)), node("c", F.lit("пункт"), F.lit(3)))
    return docs(s, d).select("doc_id", F.array_join(F.transform(html.article_nodes(nodes), lambda n: n["id"]), ",").alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 7 WHEN doc_id % 2 = 0 THEN 2000 WHEN doc_id % 3 = 0 THEN 1000 ELSE 7 END::BIGINT AS redid FROM documents")
def pick_redaction(s, d):
    k = F.col("doc_id")
    red = lambda actual, has, i: F.struct(actual.alias("actual"), has.alias("hascontent"), F.lit(i).cast("long").alias("redid"))
    reds = F.array(red(F.lit(False), k % 3 == 0, 1000), red(F.lit(True), k % 2 == 0, 2000))
    return docs(s, d).select("doc_id", html.pick_redaction(reds, F.lit(7).cast("long"), F.when(k % 5 == 0, "error")).alias("redid"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 AND contains(md5(doc_id::VARCHAR), i::VARCHAR) THEN NULL ELSE i END AS redid FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 5000 + doc_id WHEN 1 THEN 2000000 + doc_id WHEN 2 THEN 1000 + doc_id % 900000 WHEN 3 THEN doc_id WHEN 4 THEN 1000 + doc_id % 900000 WHEN 6 THEN 5000 + doc_id WHEN 7 THEN 1000 + doc_id % 900000 WHEN 8 THEN doc_id % 800 END AS i FROM documents)""")
def redid_cascade(s, d):
    i, k = F.col("doc_id"), F.col("doc_id") % 9
    big, huge, small = (5000 + i).cast("string"), (2_000_000 + i).cast("string"), (1000 + i % 900_000).cast("string")
    page = (
        F.when(k == 0, F.concat(F.lit('<script>var redid: 7777;</script><a data-redid="'), big, F.lit('">')))
        .when(k == 1, F.concat(F.lit("<script>redid = 12; window.redid = "), huge, F.lit(";</script><p>doc 4444</p>")))
        .when(k == 2, F.concat(F.lit("/proxy/?rdk="), small, F.lit("&x=1")))
        .when(k == 3, F.concat(F.lit("<meta content='id "), i.cast("string"), F.lit("' name='x-RedId'><script>redid=8888</script>")))
        .when(k == 4, F.concat(F.lit("<p>000123 "), small, F.lit(" is the <b>doc</b></p>")))
        .when(k == 5, F.concat(F.lit("<p>redid and a good deal of other words "), small, F.lit("</p>")))
        .when(k == 6, F.concat(F.lit("<script>{'rdk': '"), big, F.lit("'}</script>")))
        .when(k == 7, F.concat(F.lit("<p>rdk no. 12 or "), small, F.lit("</p>")))
        .when(k == 8, F.concat(F.lit("<script>let  rdk = 12; const redid = 5; window.rdk="), (i % 800).cast("string"), F.lit("</script>")))
        .otherwise("no id here")
    )
    found = html.redid(page)
    return docs(s, d).select("doc_id", F.when(i % 6 == 0, html.not_in_hash(found, F.md5(i.cast("string").cast("binary")))).otherwise(found).alias("redid"))


@query("SELECT host, unnest(range(1, c + 1)) AS n, 'https://' || host || '/law/' || unnest(range(1, c + 1)) || '/' AS link FROM (SELECT split_part(url, '/', 3) AS host, count(*) AS c FROM pages GROUP BY 1)")
def link_generator(s, d):
    """Numbered links of each host, as many as it has pages."""
    hosts = pages(s, d).groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(F.count(F.lit(1)).alias("limit"))
    return html.numbered_links(hosts.withColumn("template", F.concat(F.lit("https://"), "host", F.lit("/law/{}/")))).select("host", "n", "link")


@query("SELECT dataset, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(item_id) AS items FROM (SELECT lang AS dataset, n_chars, NULL AS item_id FROM documents WHERE lang IN ('de', 'en') UNION ALL SELECT 'benchmark', length(text), item_id FROM benchmark) GROUP BY dataset")
def union_datasets(s, d):
    parts = {x: docs(s, d).filter(F.col("lang") == x).select("n_chars") for x in ("de", "en")}
    parts["benchmark"] = s.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.length("text").cast("long").alias("n_chars"))
    return sets.union(parts).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count("item_id").alias("items"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS rank FROM documents QUALIFY rank <= 30")
def target_cap(s, d):
    return sets.cap(docs(s, d).select("source", "doc_id"), "source", ["doc_id"], 30)


@query(rf"""WITH w AS (SELECT doc_id, lang AS u, regexp_extract_all(text, '[\s\x0b\x1c-\x1f]*[^\s\x0b\x1c-\x1f]+(?:[\s\x0b\x1c-\x1f]+$)?') AS w, text FROM documents),
    n AS (SELECT *, CASE WHEN len(w) <= 199 THEN 1 ELSE 1 + ceil((len(w) - 199) / 195.0)::INTEGER END AS k FROM w), p AS (SELECT *, unnest(range(1, k + 1)) AS part FROM n)
    SELECT doc_id, part::INTEGER AS part_no, CASE WHEN part > 1 THEN u || chr(10) || chr(10) || 'Продолжи ответ. Часть ' || part || '.' ELSE u END AS user_text,
    md5(CASE WHEN k = 1 THEN text WHEN part = 1 THEN array_to_string(w[1:199], '') ELSE array_to_string(w[200 + (part - 2) * 195:199 + (part - 1) * 195], '') END) AS answer FROM p""")
def example_split(s, d):
    rows = chunk.answer_parts(docs(s, d).select("doc_id", F.col("lang").alias("user"), F.col("text").alias("answer")), 200)
    return rows.select("doc_id", "part_no", F.col("user").alias("user_text"), F.md5(F.col("answer").cast("binary")).alias("answer"))


@query("SELECT event_id, props->>'$.k' AS k, len(json_keys(props::JSON))::INTEGER AS n_keys FROM events")
def json_ingest(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')").alias("k"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query(f"""WITH p AS (SELECT url, page_id::VARCHAR AS title, html AS t FROM pages WHERE length({sql_strip('html')}) >= 200),
    c AS (SELECT *, unnest(range(CASE WHEN length(t) > 2500 THEN ceil((length(t) - 400) / 2100.0)::INTEGER ELSE 1 END)) AS chunk_no FROM p)
    SELECT 'chunk_' || lpad((row_number() OVER (ORDER BY url, title, chunk_no) - 1)::VARCHAR, 6, '0') AS chunk_id, url AS article_url, (chunk_no * 2100)::INTEGER AS chunk_start, least(chunk_no * 2100 + 2500, length(t))::INTEGER AS chunk_end,
    CASE WHEN len(string_split(url, '/')) >= 4 THEN upper(split_part(url, '/', 4)) END AS legal_code FROM c""")
def article_index(s, d):
    rows = pages(s, d).select("url", F.col("page_id").cast("string").alias("title"), F.col("html").alias("content"))
    return pipelines.article_chunks(rows).select("chunk_id", "article_url", "chunk_start", "chunk_end", "legal_code")


@query(f"""WITH p AS (SELECT split_part(url, '/', 3) AS url, html AS t FROM pages WHERE length({sql_strip('html')}) >= 200),
    c AS (SELECT *, unnest(range(CASE WHEN length(t) > 2500 THEN ceil((length(t) - 400) / 2100.0)::INTEGER ELSE 1 END)) AS chunk_no FROM p)
    SELECT 'chunk_' || lpad((row_number() OVER (ORDER BY url, md5(t), chunk_no) - 1)::VARCHAR, 6, '0') AS chunk_id, url AS article_url, md5(substring(t, chunk_no * 2100 + 1, 2500)) AS document FROM c""")
def chunk_ids_of_repeats(s, d):
    """Ids where many articles share url and title: one for each chunk."""
    rows = pages(s, d).select(F.split_part("url", F.lit("/"), F.lit(3)).alias("url"), F.lit("Untitled").alias("title"), F.col("html").alias("content"))
    return pipelines.article_chunks(rows).select("chunk_id", "article_url", F.md5(F.col("document").cast("binary")).alias("document"))


@query(f"WITH {CONV} SELECT md5({sql_rendered()}) AS rendered, count(*) AS n FROM conv GROUP BY 1")
def jsonl_round_trip(s, d):
    """Conversations written as JSONL and read line by line."""
    path = scratch.fresh_path(s)
    sinks.jsonl(turns(s, d), path)
    m = F.expr(f"try_variant_get(try_parse_json(item), '$.messages', '{messages.MESSAGES}')")
    return readers.lines(s, path).select(F.md5(messages.rendered(m).cast("binary")).alias("rendered")).groupBy("rendered").agg(F.count(F.lit(1)).alias("n"))


ITEM_TEXT = "'Статья ' || doc_id || '. ' || text"


@query(rf"""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'gk' WHEN 1 THEN 'tk' ELSE 'koap' END AS code, doc_id % 5 AS form, 'Вопрос ' || doc_id AS q, {ITEM_TEXT} AS t FROM documents WHERE doc_id % 5 < 4),
    n AS (SELECT *, coalesce(nullif(replace(regexp_extract(t, '(?i)Статья\s+(\d+(?:\s+\d+)?)', 1), ' ', '_'), ''), 'unknown') AS number FROM f),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 3, doc_id // 300 ORDER BY doc_id) - 1 AS idx FROM documents)
    SELECT 'actual_' || CASE code WHEN 'gk' THEN 'gk_rf' WHEN 'tk' THEN 'TK_RF' ELSE code END || '_' || (n.doc_id // 300) || '_' || idx AS source_id, code, number AS article_number, code || '_' || number AS group_id, form < 2 AS is_messages_format, md5(CASE WHEN form < 3 THEN q ELSE 'Какая статья из ' || upper(code) || ' кодекс РФ регулирует: ' || q END) AS raw_case, md5(t) AS raw_article FROM n JOIN p USING (doc_id)""")
def raw_ingest(s, d):
    """Records of the four forms (and others, which go) written as array files and read as a raw folder; codes come from file names."""
    i = F.col("doc_id")
    code = F.when(i % 3 == 0, "gk").when(i % 3 == 1, "tk").otherwise("koap")
    asked, text = F.concat(F.lit("Вопрос "), i.cast("string")), F.concat(F.lit("Статья "), i.cast("string"), F.lit(". "), F.col("text"))
    chat = F.array(messages.message("user", asked), messages.message("assistant", text))
    pair = lambda a, b: F.to_json(F.struct(asked.alias(a), text.alias(b)))
    item = F.when(i % 5 == 0, F.to_json(chat)).when(i % 5 == 1, F.to_json(F.struct(chat.alias("messages")))).when(i % 5 == 2, pair("case", "article")).when(i % 5 == 3, pair("title", "content")).otherwise('{"note": 1}')
    rows = docs(s, d).select(code.alias("code"), F.floor(i / 300).alias("part"), item.alias("item"), "doc_id")
    files = rows.groupBy("code", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("x"))  # 100 items at most
    files = files.select("code", "part", F.concat(F.lit("["), F.array_join(F.transform("x", lambda y: y["item"]), ","), F.lit("]")).alias("value"))
    path, out = scratch.fresh_path(s), scratch.fresh_path(s)
    fs_path = s._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(out).getFileSystem(s._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(out))
    files.write.partitionBy("code", "part").text(path)
    for f in fs.globStatus(fs_path(f"{path}/code=*/part=*/part-*")):  # a file an array
        code_, part = (f.getPath().toString().split(f"/{name}=")[1].split("/")[0] for name in ("code", "part"))
        fs.rename(f.getPath(), fs_path(f"{out}/actual_{dict(gk='gk_rf', tk='TK_RF').get(code_, code_)}_{part}.json"))
    got = readers.raw_directory(s, out)
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return got.select("source_id", "code", "article_number", "group_id", "is_messages_format", digest("raw_case"), digest("raw_article"))


@query(BASE.replace("tagged AS", "t AS") + """, r AS (SELECT coalesce(reason, 'kept') AS k, count(*) AS n FROM t GROUP BY 1)
    SELECT (SELECT count(*) FROM t) AS initial_count, (SELECT count(*) FROM t WHERE reason IS NULL) AS after_dedup, coalesce((SELECT n FROM r WHERE k = 'exact_duplicate'), 0) AS exact_duplicates, (SELECT count(*) FROM r WHERE k <> 'kept') AS n_reasons""")
def report_written(s, d):
    """The preprocessing report, from the file that it is written to."""
    rows, path = tagged(s, d), scratch.fresh_path(s)
    sinks.report(profile.stage_report(rows), profile.reason_histogram(rows), path)
    told = F.col("removed_reasons")
    return s.read.schema("initial_count long, after_dedup long, removed_reasons map<string, long>").json(path).select("initial_count", "after_dedup", F.coalesce(F.try_element_at(told, F.lit("exact_duplicate")), F.lit(0)).alias("exact_duplicates"), F.size(told).cast("long").alias("n_reasons"))


@query(f"""WITH {CONV}, h AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, {NOISY_SQL} AS noisy FROM conv) SELECT dataset, count(*) AS total_records, count(*) FILTER (noisy) AS noise_count FROM h GROUP BY dataset""")
def health_written(s, d):
    """The health report, from the file that it is written to."""
    path = scratch.fresh_path(s)
    sinks.health_report(profile.health(turns(s, d), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")), path)
    told = s.read.schema("datasets map<string, struct<total_records: long, noise_count: long>>").json(path)
    return told.select(F.explode("datasets").alias("dataset", "x")).select("dataset", "x.total_records", "x.noise_count")


@query(f"""WITH {CONV}, {LOADED} SELECT md5({sql_rendered()}) AS rendered, count(*) AS n FROM loaded WHERE m IS NOT NULL GROUP BY 1""")
def training_read(s, d):
    """Conversations written as JSONL, read strictly and normalized for training."""
    path = scratch.fresh_path(s)
    sinks.jsonl(turns(s, d), path)
    rows = readers.training_records(s, path)
    m = messages.loader_messages(F.col("messages"))
    return rows.select(m.alias("m")).filter("m is not null").select(F.md5(messages.rendered(F.col("m")).cast("binary")).alias("rendered")).groupBy("rendered").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHUNKS} SELECT 'chunk_' || lpad((row_number() OVER (ORDER BY url, md5(text), chunk_no) - 1)::VARCHAR, 6, '0') AS chunk_id, url AS article_url, 't' || doc_id % 7 AS article_title, upper(lang) AS legal_code, (chunk_no * 2100)::INTEGER AS chunk_start,
    least(chunk_no * 2100 + 2500, length(text))::INTEGER AS chunk_end, md5(substring(text, chunk_no * 2100 + 1, 2500)) AS document, true AS same_vector FROM (SELECT *, 'https://h/' || lang || '/' || doc_id AS url FROM chunks JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))""")
def index_round_trip(s, d):
    """Chunks of articles read from JSON, embedded, published as an index in folders by code over an older version, and read back: ids, metadata and vectors."""
    source, index = scratch.fresh_path(s), scratch.fresh_path(s)
    rows = docs(s, d).select(F.concat(F.lit("https://h/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("title"), F.col("text").alias("content"))
    rows.write.json(source)
    chunks = pipelines.article_chunks(readers.articles_lines(s, source))
    vector.build_index(chunks.limit(10), vector.hashed, index)
    vector.build_index(chunks, vector.hashed, index)
    got = vector.open_index(s, index)
    again = vector.hashed(got.withColumnRenamed("embedding", "stored")).withColumn("same_vector", F.col("embedding").eqNullSafe(F.col("stored")))
    return again.select("chunk_id", "article_url", "article_title", "legal_code", "chunk_start", "chunk_end", F.md5(F.col("document").cast("binary")).alias("document"), "same_vector")


@query()
def fitted_embedding(s, d):
    """Embeddings of all documents, fitted on them."""
    rows = docs(s, d).select("doc_id", F.col("text").alias("document"))
    return embedding.fit(rows).embed(rows).select("doc_id", "embedding")


@query(f"SELECT law_code, law, count(*) AS n FROM ({SQL['law_label']}) GROUP BY ALL")
def labels_written(s, d):
    """Labelled records, from the file that they are written to."""
    path = scratch.fresh_path(s)
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    article = F.when(m == 0, F.concat(F.lit("Статья "), i, F.lit(" ГК РФ"))).when(m == 1, F.concat(F.lit("статья "), i, F.lit(" тк"))).when(m == 2, "Статья 1 КоАП").when(m == 3, F.concat(F.lit("Статья "), i, F.lit(". Понятие"))).otherwise(F.col("text"))
    sinks.rows_json(pipelines.labelled(docs(s, d).select(article.alias("article"), F.when(m == 4, "").otherwise("Статья 9 УК").alias("title"))), path)
    return s.read.schema("law string, law_code string").json(path).groupBy("law_code", "law").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang AS code, count(*) AS records, count(DISTINCT source) AS groups, count(*) FILTER (n_chars >= 1000) AS kept_records, count(DISTINCT source) FILTER (n_chars >= 1000) AS kept_groups FROM documents GROUP BY lang")
def code_counts(s, d):
    rows = docs(s, d).select(F.col("lang").alias("code"), F.concat_ws("_", "lang", "source").alias("group_id"), F.when(F.col("n_chars") < 1000, "short").alias("reason"))
    return profile.code_counts(rows)


@query("SELECT lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM pages) AS share FROM pages GROUP BY 1")
def domain_distribution(s, d):
    return profile.domains(pages(s, d), "url")


@query("SELECT unit, count(*) AS n FROM (SELECT unnest([CASE WHEN doc_id % 2 = 0 THEN 'статья' ELSE '' END, 'глава']) AS unit FROM documents) GROUP BY unit")
def unit_counts(s, d):
    node = lambda unit: F.struct(unit.alias("unit"))
    nodes = docs(s, d).select(F.array(node(F.when(F.col("doc_id") % 2 == 0, "статья")), node(F.lit("глава"))).alias("nodes"))
    return profile.units(nodes)


@query(r"SELECT count(*) AS n, count(*) FILTER (k > 300) AS overlong, count(*) FILTER (k <= 300) AS fitting FROM (SELECT greatest(1, len(list_filter(string_split_regex(text, '[\s-]+'), lambda x: x <> ''))) AS k FROM documents)")
def overlong_counts(s, d):
    return profile.size_counts(docs(s, d), X.token_count(F.col("text")), 300)


@query(r"SELECT doc_id FROM documents WHERE greatest(1, len(list_filter(string_split_regex(text, '[\s-]+'), lambda x: x <> ''))) <= 300")
def overlong_filter(s, d):
    return docs(s, d).filter(~quality.overlong(F.col("text"), 300)).select("doc_id")


def queries() -> dict[str, Query]:
    from loam.plans import catalogue_files  # registers its own

    return dict(catalogue_files.catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
