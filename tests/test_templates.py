"""Chat templates against plain renderings of the same conversations."""

import pytest
from pyspark.sql import functions as F

from loam.functions import templates
from loam.operators import messages

CHATS = [
    [("user", " Hi "), ("assistant", "Hello.\n")],
    [("system", "Be brief.  "), ("user", "One?"), ("assistant", "1"), ("user", "Two?"), ("assistant", " 2 ")],
    [("system", "S")],
    [("user", "only")],
    [],
]

CHATML = """{% for message in messages %}{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"""

HEADERS = """{%- set loop_messages = messages %}
{%- for message in loop_messages %}
    {%- set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\n\n' + message['content'] | trim + '<|eot_id|>' %}
    {%- if loop.index0 == 0 %}
        {%- set content = bos_token + content %}
    {%- endif %}
    {{- content }}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|start_header_id|>assistant<|end_header_id|>\n\n' }}
{%- endif %}
"""

INST = """{% if messages[0]['role'] == 'system' %}
{% set loop_messages = messages[1:] %}
{% set system_message = messages[0]['content'] %}
{% else %}
{% set loop_messages = messages %}
{% set system_message = false %}
{% endif %}
{% for message in loop_messages %}
    {% if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}
        {{ raise_exception('Roles must alternate') }}
    {% endif %}
    {% if loop.first and system_message %}
        {% set content = '<<SYS>>\n' + system_message + '\n<</SYS>>\n\n' + message['content'] %}
    {% else %}
        {% set content = message['content'] %}
    {% endif %}
    {% if message['role'] == 'user' %}
{{ bos_token + '[INST] ' + content.strip() + ' [/INST]' }}
    {%- elif message['role'] == 'assistant' %}
{{ ' ' + content.strip() + ' ' + eos_token }}
    {%- endif %}
{% endfor %}"""


def chatml(chat, prompt):
    return "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in chat) + ("<|im_start|>assistant\n" if prompt else "")


def headers(chat, prompt):
    out = "".join(("<s>" if i == 0 else "") + f"<|start_header_id|>{r}<|end_header_id|>\n\n{c.strip()}<|eot_id|>" for i, (r, c) in enumerate(chat))
    return out + ("<|start_header_id|>assistant<|end_header_id|>\n\n" if prompt else "")


def inst(chat, prompt):
    system, rest = ("", chat) if not chat or chat[0][0] != "system" else (chat[0][1], chat[1:])
    out = ""
    for i, (r, c) in enumerate(rest):
        if i == 0 and system:
            c = f"<<SYS>>\n{system}\n<</SYS>>\n\n{c}"
        out += f"<s>[INST] {c.strip()} [/INST]" if r == "user" else f" {c.strip()} </s>"
        out += "" if r in ("user", "assistant") else ""
    return out


def rendered(spark, template, chats=CHATS, **given):
    rows = [(i, None if c is None else [{"role": r, "content": x} for r, x in c]) for i, c in enumerate(chats)]
    df = spark.createDataFrame(rows, f"i int, m {messages.MESSAGES}")
    return [r["t"] for r in df.select("i", templates.render(template, F.col("m"), **given).alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("prompt", [False, True])
@pytest.mark.parametrize(("template", "plain"), [(CHATML, chatml), (HEADERS, headers), (INST, inst)])
def test_published_shapes(spark, template, plain, prompt):
    got = rendered(spark, template, bos_token="<s>", eos_token="</s>", add_generation_prompt=prompt)
    assert got == [plain(c, prompt) for c in CHATS]


CASES = [
    ("{{ messages|length }}{% if messages[-1].role == 'assistant' %}!{% endif %}", lambda c: f"{len(c)}" + ("!" if c and c[-1][0] == "assistant" else "")),
    ("{% for m in messages %}{{ loop.index }}/{{ loop.length }}{{ ',' if not loop.last else '.' }}{% endfor %}", lambda c: "".join(f"{i + 1}/{len(c)}{',' if i + 1 < len(c) else '.'}" for i in range(len(c)))),
    ("{% for m in messages[1:-1] %}[{{ m.content | trim | upper }}]{% endfor %}", lambda c: "".join(f"[{x.strip().upper()}]" for _, x in c[1:-1])),
    ("{% for m in messages if true else messages %}{{ m.role ~ loop.index0 }}{% endfor %}", lambda c: "".join(f"{r}{i}" for i, (r, _) in enumerate(c))),
    ("{% for m in messages %}{% if m.role in ['user', 'system'] and 'o' in m.content %}+{% elif not m.name is defined %}-{% else %}?{% endif %}{% endfor %}", lambda c: "".join("+" if r in ("user", "system") and "o" in x else "-" for r, x in c)),
    ("{# note #}{% set x = 'a' %}{% for m in messages %}{% set x = x + m.role %}{% endfor %}{{ x }}{{ nothing }}", lambda c: "a"),
    ("{% for m in messages %}{{ m['content'].split('.')[0] }}|{{ m.content.startswith('O') }}{% endfor %}", lambda c: "".join(f"{x.split('.')[0]}|{str(x.startswith('O')).lower()}" for _, x in c)),
    ("  a\n  {% if true %}\n  b\n  {% endif %}\nc {{- ' d' -}}  \n e", lambda c: "  a\n  b\nc de"),
]


@pytest.mark.parametrize(("template", "plain"), CASES)
def test_parts_of_the_language(spark, template, plain):
    assert rendered(spark, template) == [plain(c) for c in CHATS]


def test_null_messages_and_contents(spark):
    got = rendered(spark, CHATML, [None, [("user", None)]], add_generation_prompt=False)
    assert got == [None, "<|im_start|>user\n<|im_end|>\n"]


def test_templates_that_refuse_a_conversation(spark):
    with pytest.raises(Exception, match="Roles must alternate"):
        rendered(spark, INST, [[("assistant", "x")]], bos_token="", eos_token="")


@pytest.mark.parametrize("template", ["{% macro f() %}{% endmacro %}", "{% for m in messages %}", "{% endif %}", "{{ messages | tojson }}", "{{ 3 * 4 }}", "{% for x in 'abc' %}{% endfor %}", "{{ a b }}", "{% if true %}"])
def test_what_is_not_understood_is_an_error_at_once(spark, template):
    with pytest.raises(ValueError):
        templates.render(template, F.col("m"))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([([{"role": "user", "content": "x"}],)], f"m {messages.MESSAGES}").select(templates.render(INST, F.col("m"), bos_token="a", eos_token="b"))
    assert "Python" not in df._jdf.queryExecution().toString()
