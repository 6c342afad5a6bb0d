"""The driver's tables, and inputs derived from them in the same SQL for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Derived inputs; {K} is the number in events.props, which each engine reads from JSON in its own way.
DERIVED = {
    "acts": "SELECT event_id, ts, user_id, event_type, value, CAST({K} AS INT) AS k FROM events",
    "votes": """SELECT event_id, user_id, k, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'flipped' END AS direction,
        CASE WHEN k < 45 THEN 'Answer: A' WHEN k < 90 THEN 'Answer: B' WHEN k < 95 THEN concat('Answer: A', chr(10), 'Answer: B it is') ELSE 'I cannot say' END AS raw,
        CASE WHEN k < 45 THEN 'A' WHEN k < 90 THEN 'B' END AS label
        FROM (SELECT event_id, user_id, k, user_id % 12 AS x, (user_id + 1 + k % 11) % 12 AS y FROM acts) e""",
    "probs": "SELECT event_id, a, b, direction, CASE WHEN k >= 90 THEN NULL ELSE CAST(k AS DOUBLE) / 90 END AS p_a FROM votes",
    "forecasts": "SELECT event_id, user_id AS record, event_id % 3 AS rotation, CASE k % 4 WHEN 0 THEN 'MORE' WHEN 1 THEN 'LESS' WHEN 2 THEN 'SAME' END AS label FROM acts",
    "samples": """SELECT l_orderkey AS problem, l_linenumber AS sample, l_partkey AS part, l_returnflag = 'A' AS correct, o_orderpriority AS difficulty, o_orderstatus AS platform, o_orderdate AS contest_date,
        l_linestatus = 'F' AS finished, CASE WHEN l_tax < 0.01 THEN '' ELSE 'x = 1' END AS code, CAST(l_quantity AS INT) AS tokens
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "graded": "SELECT problem, difficulty, platform, contest_date, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS c FROM samples GROUP BY problem, difficulty, platform, contest_date",
    "rollouts": "SELECT l_orderkey AS record_id, CAST(l_suppkey % 2 AS INT) AS reward_call, l_linenumber AS pos, CASE WHEN l_linestatus = 'O' THEN NULL ELSE round(l_discount * 10, 6) END AS reward, concat('p', l_partkey) AS text FROM lineitem",
    "arms": "SELECT l_partkey AS item, CASE WHEN l_linenumber % 2 = 1 THEN 'base' ELSE 'arm' END AS arm, l_returnflag = 'A' AS solved, l_discount AS reward, l_linestatus = 'F' AS finished FROM lineitem",
    "attempts": """SELECT user_id AS record_id, concat('run', event_id % 3) AS run_id, ts AS started_at, value AS elapsed_seconds, k * 10 AS input_tokens, k * 3 AS output_tokens, event_type = 'error' AS api_error,
        CASE WHEN event_type = 'error' THEN NULL ELSE CAST(k % 5 AS DOUBLE) / 4 END AS pass_rate, event_id AS pos FROM acts""",
    "choices": "SELECT o_custkey AS idx, CASE WHEN o_orderkey % 2 = 0 THEN 'forward' ELSE 'reverse' END AS ord, CASE WHEN o_totalprice < 250000 THEN 'first' ELSE 'second' END AS choice, o_orderkey AS pos FROM orders",
    "utilities": "SELECT CAST(substr(p_brand, 7) AS INT) AS id, round(avg(p_retailprice) / 1000, 6) AS mean, round(var_samp(p_retailprice) / 100000, 6) AS variance FROM part GROUP BY p_brand",
    "responses": """SELECT doc_id AS rid, CASE doc_id % 12
        WHEN 0 THEN concat('I weighed both.', chr(10), 'Answer: A') WHEN 1 THEN concat('Hm.', chr(10), '**Answer: b**') WHEN 2 THEN concat('Answer: A', chr(10), 'Wait, no.', chr(10), 'Answer: B')
        WHEN 3 THEN 'Answer: A (or B).' WHEN 4 THEN 'B' WHEN 5 THEN 'I prefer A to the rest' WHEN 6 THEN 'A or B' WHEN 7 THEN '' WHEN 8 THEN NULL
        WHEN 9 THEN concat('<think>long thoughts about it', chr(10), '</think>Answer: A') WHEN 10 THEN concat('> Answer: A.', chr(10), chr(10)) ELSE 'never ending words without' END AS raw,
        CASE doc_id % 7 WHEN 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM documents""",
    "completions": """SELECT doc_id AS cid, CASE doc_id % 8
        WHEN 0 THEN concat('Text', chr(10), '```python', chr(10), 'x = 1', chr(10), '```', chr(10), 'and', chr(10), '```go', chr(10), 'y := 2', chr(10), '```')
        WHEN 1 THEN concat('<think>ideas here for a while</think>', '```rust', chr(10), 'let z = 3;', chr(10), '// YOUR CODE HERE', chr(10), '```')
        WHEN 2 THEN concat('```python', chr(10), 'cut off') WHEN 3 THEN 'no code at all' WHEN 4 THEN concat('```', chr(10), 'plain', chr(10), '```')
        WHEN 5 THEN '' WHEN 6 THEN concat('<think>never closed', chr(10), 'more') ELSE concat('thinking</think>', chr(10), 'shown') END AS content,
        CASE doc_id % 5 WHEN 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM documents""",
    "runs": """SELECT event_id AS pos, user_id AS record_id, CASE k % 8 WHEN 1 THEN 124 WHEN 2 THEN 137 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN NULL ELSE 0 END AS exit_code,
        CASE k % 8 WHEN 1 THEN 'TimeoutExpired: 5 s' WHEN 2 THEN 'java.lang.OutOfMemoryError' WHEN 3 THEN 'panic at line 3' WHEN 4 THEN 'SyntaxError: token' WHEN 5 THEN 'ValueError' ELSE '' END AS stderr, k FROM acts""",
    "traces": """SELECT record_id, content_id, sibling, labels, verifiable, prompt, label, CASE WHEN record_id % 26 = 14 THEN 'C' WHEN record_id % 13 = 9 THEN NULL ELSE label END AS answer,
        CASE record_id % 40
        WHEN 1 THEN concat(t, '</think>', chr(10), 'Answer: ', label, '<|im_end|>') WHEN 2 THEN t WHEN 3 THEN concat(t, '</think></think>', chr(10), 'Answer: ', label) WHEN 4 THEN concat(t, '</think>', chr(10), 'I think it is ', label)
        WHEN 5 THEN concat(t, '</think>', chr(10), 'So in short.', chr(10), chr(10), 'Answer: ', label) WHEN 6 THEN concat('The user wants six bullet points. ', t, '</think>', chr(10), 'Answer: ', label) WHEN 7 THEN concat('Too short.', '</think>', chr(10), 'Answer: ', label)
        WHEN 8 THEN concat('<think>', t, '</think>', chr(10), 'Answer: ', label) WHEN 9 THEN concat('- ', t, '</think>', chr(10), 'Answer: ', label) WHEN 10 THEN concat('**Plan** ', t, '</think>', chr(10), 'Answer: ', label)
        WHEN 11 THEN concat('Use `x`. ', t, '</think>', chr(10), 'Answer: ', label) WHEN 12 THEN concat('Answer: maybe. ', t, '</think>', chr(10), 'Answer: ', label) WHEN 13 THEN concat(t, chr(10), 'It depends on taste.</think>', chr(10), 'Answer: ', label)
        WHEN 14 THEN concat('Odd​ sign. ', t, '</think>', chr(10), 'Answer: ', label) WHEN 15 THEN concat(t, '</think>', chr(10), '> **Answer: ', lower(label), '**.', chr(10), chr(10)) WHEN 16 THEN NULL WHEN 17 THEN '' WHEN 18 THEN concat(t, '</think>', chr(10), 'Answer: none of these')
        ELSE concat(t, '</think>', chr(10), chr(10), 'Answer: ', label) END AS completion
        FROM (SELECT doc_id AS record_id, CAST(floor(doc_id / 2) AS BIGINT) AS content_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 15 = 1 THEN 0 ELSE 1 END AS sibling, coalesce(text, '') AS t, doc_id % 5 <> 0 AS verifiable,
            CASE WHEN doc_id % 6 = 0 THEN 'MORE,LESS,SAME' WHEN doc_id % 6 = 1 THEN 'HIGHER,LOWER,UNCHANGED' ELSE 'A,B' END AS labels,
            CASE WHEN doc_id % 42 = 1 THEN 'LOWER' WHEN doc_id % 6 = 0 THEN 'MORE' WHEN doc_id % 6 = 1 THEN 'HIGHER' WHEN doc_id % 22 = 5 THEN 'A' WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS label,
            concat('Pick one.', chr(10), chr(10), 'Option A:', chr(10), CASE WHEN doc_id % 2 = 0 THEN 'Tidy  the shed' ELSE 'Paint the fence' END, chr(10), chr(10), 'Option B:', chr(10), CASE WHEN doc_id % 2 = 0 THEN 'paint the fence' ELSE 'tidy the shed' END, chr(10)) AS prompt
            FROM documents) d""",
    "drafts": """SELECT doc_id AS rid, substr(text, 1, 150) AS first, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 140) ELSE substr(text, 200, 150) END AS second, CASE doc_id % 11
        WHEN 0 THEN concat(substr(text, 1, 120), ' x.') WHEN 1 THEN concat(text, chr(10), 'I would take B.') WHEN 2 THEN concat('A or B? ', text, ' So A it is.') WHEN 3 THEN concat('A beats B. ', text, '. Both A and B are fine.') WHEN 4 THEN concat(text, chr(10), '**Final answer: b**.')
        WHEN 5 THEN concat(text, ' Say "Answer: A" or "Answer: B" exactly as told.') WHEN 6 THEN concat('<think>', text) WHEN 7 THEN concat(text, ' and') WHEN 8 THEN concat(text, chr(10), '(A)') WHEN 9 THEN text ELSE concat(substr(text, 200, 140), ' y.') END AS raw FROM documents""",
    "told": """SELECT conv_id, turn, concat(CASE (conv_id + turn) % 9 WHEN 0 THEN 'I''m sorry, but I cannot ' WHEN 1 THEN ' i can''t say. ' WHEN 2 THEN 'I am not able to. ' WHEN 3 THEN 'Well, I cannot. ' WHEN 4 THEN 'I said to my friend that we''re fine. ' WHEN 5 THEN 'I won''t. ' WHEN 6 THEN 'I''ve lost MY keys, and our cat. ' ELSE '' END, text) AS text FROM conversations""",
    "example_turns": """SELECT conv_id AS line_no, turn, CASE WHEN conv_id % 17 = 3 AND turn = 0 THEN 'tool' WHEN conv_id % 19 = 4 THEN 'assistant' ELSE role END AS role,
        CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN '  ' WHEN conv_id % 11 = 2 AND role = 'user' THEN 'The same question twice' WHEN conv_id % 23 = 6 THEN concat(text, ' ', snippet) ELSE text END AS content
        FROM conversations JOIN (SELECT min(text) AS snippet FROM benchmark) b ON TRUE""",
    "example_heads": """SELECT line_no, CASE WHEN line_no % 29 = 8 THEN NULL WHEN line_no % 31 = 9 THEN 'ex-0' ELSE concat('ex-', line_no) END AS id, CASE WHEN line_no % 37 = 1 THEN 'other' ELSE 'style' END AS intervention_id, CASE WHEN line_no % 41 = 2 THEN 'chat' ELSE 'coding' END AS task,
        CASE WHEN line_no % 43 = 3 THEN 'go' ELSE 'rust' END AS language_id, CASE WHEN line_no % 47 = 4 THEN 'test' WHEN line_no % 47 = 5 THEN 'pool' ELSE 'train' END AS split, CASE WHEN line_no % 53 = 6 THEN ' ' ELSE 'web' END AS source, CASE WHEN line_no % 59 = 7 THEN '' WHEN line_no % 61 = 8 THEN NULL ELSE 'MIT' END AS license
        FROM (SELECT DISTINCT conv_id AS line_no FROM conversations) c""",
    "distilled": """SELECT doc_id AS line_no, CASE WHEN doc_id % 23 = 1 THEN 'sft_v0' ELSE 'sft_distill_v1' END AS schema, CASE WHEN doc_id % 29 = 2 THEN 'mock' END AS mock_note, CASE WHEN doc_id % 31 = 3 THEN '' WHEN doc_id % 37 = 4 THEN 'r0' ELSE concat('r', doc_id) END AS record_id,
        CASE WHEN doc_id % 41 = 5 THEN 'other' ELSE 'set' END AS dataset_id, CASE WHEN doc_id % 43 = 6 THEN 'REPLACE-WITH-REAL-TEACHER-MODEL-ID' WHEN doc_id % 43 = 7 THEN '' ELSE 'teacher' END AS teacher_model, CASE WHEN doc_id % 47 = 8 THEN 0.5 ELSE 1.0 END AS teacher_pass_rate,
        CASE WHEN doc_id % 53 = 9 THEN 1 WHEN doc_id % 53 = 10 THEN 3 ELSE 2 END AS n_messages, CASE WHEN doc_id % 59 = 11 THEN 'system' ELSE 'user' END AS first_role, CASE WHEN doc_id % 61 = 12 THEN concat(text, ' ') ELSE text END AS asked,
        CASE WHEN doc_id % 7 = 1 THEN concat('Here:', chr(10), '```python', chr(10), text, chr(10), '```') WHEN doc_id % 7 = 2 THEN concat(' ```python', chr(10), text, '```', chr(10)) WHEN doc_id % 7 = 3 THEN text ELSE concat('```python', chr(10), text, chr(10), '```') END AS answer FROM documents""",
    "distill_source": "SELECT concat(CASE WHEN doc_id % 67 = 13 THEN 'elsewhere' ELSE 'r' END, doc_id) AS record_id, 'set' AS dataset_id, text AS expected FROM documents",
    "cache": """SELECT CASE WHEN n % 20 = 7 THEN -1 - n ELSE n END AS question_id, n_out, n_code, translate(CASE WHEN n % 19 = 1 THEN 'not json' WHEN n % 19 = 2 THEN '[("role": "system", "content": "x")]' WHEN n % 19 = 3 THEN NULL WHEN n % 19 = 4 THEN '("role": "user")' ELSE '[("role": "system"), ("role": "user", "content": "q")]' END, '()', concat(chr(123), chr(125))) AS prompt,
        CASE n % 13 WHEN 1 THEN '' WHEN 2 THEN concat('Sure.', chr(10), '```go', chr(10), t, chr(10), '```') WHEN 3 THEN concat('```rust', chr(10), t, chr(10), '```') WHEN 4 THEN concat('```go', chr(10), t, chr(10), '```', chr(10), '```go', chr(10), t, chr(10), '```') ELSE concat('```go', chr(10), t, chr(10), '```') END AS output,
        CASE n % 13 WHEN 1 THEN '' WHEN 5 THEN ' ' ELSE t END AS code
        FROM (SELECT doc_id AS n, CASE WHEN doc_id % 17 = 6 THEN 1 ELSE 2 END AS n_out, CASE WHEN doc_id % 17 = 7 THEN 3 ELSE 2 END AS n_code, text AS t FROM documents) d""",
    "cache_questions": "SELECT CASE WHEN doc_id % 33 = 8 THEN -1000000000 - doc_id ELSE doc_id END AS question_id FROM documents",
    "cells": """SELECT doc_id AS cell, CASE doc_id % 10 WHEN 0 THEN 'Self-Direction' WHEN 1 THEN 'Security' WHEN 2 THEN 'Stimulation' WHEN 3 THEN 'Conformity' WHEN 4 THEN 'Hedonism' WHEN 5 THEN 'Tradition' WHEN 6 THEN 'Achievement' WHEN 7 THEN 'Benevolence' WHEN 8 THEN 'Power' ELSE 'Universalism' END AS value,
        concat(CASE WHEN doc_id % 7 = 1 THEN 'They ' ELSE 'You ' END, substr(text, 1, CAST(116 + doc_id % 30 AS INT)), CASE WHEN doc_id % 21 = 4 THEN ' ' ELSE '' END) AS one,
        CASE WHEN doc_id % 13 = 2 THEN '  ' WHEN doc_id % 13 = 3 THEN concat('you TODO ', substr(text, 1, 130)) ELSE concat('you ', CASE WHEN doc_id % 4 = 1 THEN 'value ' WHEN doc_id % 4 = 2 THEN 'care about ' ELSE '' END, substr(text, 20, 120)) END AS two,
        CASE WHEN doc_id % 11 = 5 THEN NULL ELSE concat('you keep ', CASE doc_id % 7 WHEN 0 THEN 'Security' WHEN 1 THEN 'the elders' WHEN 2 THEN 'power' WHEN 3 THEN 'self-direction' ELSE 'on' END, ', ', substr(text, 40, 110)) END AS three FROM documents""",
    "replies": """SELECT doc_id AS rid, CASE doc_id % 14
        WHEN 0 THEN concat(text, chr(10), 'Answer: A') WHEN 1 THEN concat(text, chr(10), '**Answer: b**') WHEN 2 THEN concat('Answer: A', chr(10), text, chr(10), 'Answer: B') WHEN 3 THEN concat(text, chr(10), 'Answer: A (or B).') WHEN 4 THEN ' b '
        WHEN 5 THEN concat('I prefer A to the rest. ', text) WHEN 6 THEN concat(text, ' A or B') WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN concat('<think>', text, chr(10), '</think>Answer: A') WHEN 10 THEN concat(text, chr(10), '> Answer: A.', chr(10), chr(10), ' ', chr(10))
        WHEN 11 THEN concat(text, chr(10), '(b).') WHEN 12 THEN concat(text, chr(10), 'Answer: Bé', chr(10), '# answer:  **a') ELSE text END AS raw FROM documents""",
    "programs": """SELECT doc_id AS cid, CASE WHEN doc_id % 5 = 0 THEN 'length' WHEN doc_id % 5 = 1 THEN NULL ELSE 'stop' END AS finish_reason, CASE doc_id % 10
        WHEN 0 THEN concat('Text', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'and', chr(10), '```go', chr(10), 'y := 2', chr(10), '```') WHEN 1 THEN concat('<think>', text, '</think>', '```rust', chr(10), text, chr(10), '// YOUR CODE HERE', chr(10), '```')
        WHEN 2 THEN concat('```python', chr(10), text) WHEN 3 THEN text WHEN 4 THEN concat('```', chr(10), text, chr(10), '```', chr(10)) WHEN 5 THEN ' ' WHEN 6 THEN concat('<think>', text) WHEN 7 THEN concat(text, '</think>', chr(10), text)
        WHEN 8 THEN concat('```c++', chr(10), text, chr(10), '``` then ```', chr(10), 'cut') ELSE concat('``` ', text, '```') END AS content FROM documents""",
    "pairs": """SELECT oid, got, CASE oid % 14 WHEN 0 THEN got WHEN 1 THEN concat(' ', got, chr(10)) WHEN 2 THEN replace(replace(got, 'e', 'E'), 'n', 'N') WHEN 3 THEN replace(got, ' ', '  ') WHEN 4 THEN concat(got, ' x') WHEN 5 THEN concat(got, ' ', chr(10), chr(10)) WHEN 6 THEN replace(got, chr(10), concat(chr(13), chr(10)))
        WHEN 7 THEN replace(got, '.25', '.2500000001') WHEN 8 THEN replace(got, '.25', '.250005') WHEN 9 THEN replace(got, '.25', '.26') WHEN 10 THEN replace(got, 'true', 'True') WHEN 11 THEN replace(got, ' 7.25', ' nan') WHEN 12 THEN NULL ELSE replace(got, ' 7.25', ' 725e-2') END AS want
        FROM (SELECT doc_id AS oid, concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(text, chr(10)) END, 'true', chr(10), doc_id % 1000, '.25 7.25') AS got FROM documents) d""",
}
_JSON = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}


def _needs(sql: str) -> list[str]:
    return [n for n in DERIVED if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = DERIVED[name]
    inputs = {n: derived(spark, sf_dir, n) for n in _needs(sql)} | {t: load(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)}
    text = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in inputs else m[0], sql.replace("{K}", _JSON["spark"]))
    return spark.sql(text, **inputs)


def oracle(sql: str) -> str:
    """The statement with the derived inputs that it names before it."""
    found: dict[str, str] = {}

    def add(text: str) -> None:
        for n in _needs(text):
            if n not in found:
                add(DERIVED[n])
                found[n] = DERIVED[n].replace("{K}", _JSON["duckdb"])

    add(sql)
    heads = ", ".join(f"{n} AS ({text})" for n, text in found.items())
    if not heads:
        return sql
    rest = sql.lstrip()
    return f"WITH {heads}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {heads} {rest}"
