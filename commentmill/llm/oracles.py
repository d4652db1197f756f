"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op7_bloom_dedup"] = f"""
WITH h AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS sha
           FROM documents),
     g AS (SELECT sha, max(doc_id) AS keep_id, count(*) AS n FROM h GROUP BY sha)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h.sha AS text_sha256
FROM h JOIN g ON h.sha = g.sha
"""

SQL["op2_chat_prefix"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    -- a backslash is doubled and every control string gets one
    length(text) + length(role)
      + (length(text || role) - length(replace(text || role, '\', '')))
      + (length(text || chr(10) || role) - length(replace(text || chr(10) || role, '<s>', ''))) / 3
      + (length(text || chr(10) || role) - length(replace(text || chr(10) || role, '</s>', ''))) / 4
      + (length(text || chr(10) || role) - length(replace(text || chr(10) || role, '[INST]', ''))) / 6
      + (length(text || chr(10) || role) - length(replace(text || chr(10) || role, '[/INST]', ''))) / 7
      + length('<s>[INST][/INST]</s>') AS chars
  FROM t),
f AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(prefix) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

SQL["op5_tensor_minhash"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2),
      lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
  FROM w),
sets AS (SELECT list_sort(shingles) AS shingles, min(doc_id) AS rep, len(any_value(shingles)) AS n
         FROM s WHERE len(shingles) > 0 GROUP BY 1),
p AS (SELECT rep, n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.shingle = b.shingle AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT DISTINCT a, a FROM edges
  UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node WHERE r.seen < e.b),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.shingles) AS n_shingles,
  coalesce(roots.root, sets.rep, s.doc_id) AS component_id,
  s.doc_id = coalesce(roots.root, sets.rep, s.doc_id) AS kept
FROM s LEFT JOIN sets ON list_sort(s.shingles) = sets.shingles LEFT JOIN roots ON roots.node = sets.rep
"""

# Shards take turns; the state of the recursion is the owner of every slot.
SQL["op6_permutation_shards"] = """
WITH RECURSIVE pref AS (
  SELECT i, name, list_transform(range(2039), lambda j:
      (('0x' || substr(md5(name || ':offset'), 1, 8))::BIGINT % 2039
       + j * (('0x' || substr(md5(name || ':skip'), 1, 8))::BIGINT % 2038 + 1)) % 2039) AS slots
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range(16) t(i))),
fill AS (
  SELECT 0::BIGINT AS turn, list_transform(range(2039), lambda j: -1::BIGINT) AS owner
  UNION ALL
  SELECT turn + 1, list_concat(owner[1:slot], [i], owner[slot + 2:])
  FROM (SELECT turn, owner, i, list_filter(slots, lambda s: owner[s + 1] = -1)[1] AS slot
        FROM fill JOIN pref ON i = turn % 16 WHERE turn < 2039)),
slots AS (SELECT unnest(range(2039)) AS slot, unnest(owner) AS i FROM fill WHERE turn = 2039),
keys AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 2039 AS slot
         FROM documents)
SELECT doc_id, keys.slot, name AS shard FROM keys JOIN slots USING (slot) JOIN pref USING (i)
"""


def _level(source: str, path: str, parent: str, name: str, weight: str, out: str) -> str:
    """One level of sharing a parent's amount out to children with caps."""
    part = f"PARTITION BY {parent}"
    order = f"{part} ORDER BY full_at, {name}"
    return f"""
{out}_a AS (SELECT *, {weight} AS weight FROM {source}),
{out}_b AS (SELECT *, (cap * 1000) // weight AS full_at FROM {out}_a WHERE weight > 0),
{out}_c AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM {out}_b),
{out}_d AS (SELECT *, cap * w <= weight * (amount - spent) AS is_full FROM {out}_c),
{out}_e AS (SELECT *, amount - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS rest,
  CASE WHEN is_full THEN 0 ELSE weight END AS ow FROM {out}_d),
{out}_f AS (SELECT *, sum(ow) OVER ({part}) AS all_ow,
  sum(ow) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM {out}_e),
{out} AS (SELECT *, CASE WHEN is_full THEN cap
    ELSE (rest * cum) // all_ow - (rest * (cum - ow)) // all_ow END AS given FROM {out}_f)"""


SQL["op8_mix_budget"] = rf"""
WITH t AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    (['web', 'books', 'forum'])[coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1) AS BIGINT),
                                         0) % 3 + 1] AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM t GROUP BY ALL),
top AS (SELECT least(sum(tokens), sum(tokens * 2)) AS amount FROM leaves),
l1 AS (SELECT 0 AS root, domain, sum(tokens * 2) AS cap, any_value(amount) AS amount FROM leaves, top GROUP BY domain),
{_level("l1", "", "root", "domain", "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END", "g1")},
l2 AS (SELECT domain, lang, sum(tokens * 2) AS cap, any_value(given) AS amount
       FROM leaves JOIN g1 USING (domain) GROUP BY domain, lang),
{_level("l2", "", "domain", "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END", "g2")},
l3 AS (SELECT domain, lang, source, tokens, tokens * 2 AS cap, given AS amount
       FROM leaves JOIN (SELECT domain, lang, given FROM g2) USING (domain, lang)),
{_level("l3", "", "domain, lang", "source", "CASE source WHEN 'src0' THEN 2 ELSE 1 END", "g3")},
b AS (SELECT domain, lang, source, given // tokens AS epochs, given % tokens AS rest FROM g3 WHERE tokens > 0),
d AS (SELECT t.*, epochs, rest, md5('7:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS h
      FROM t JOIN b USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, unnest(range(epochs::BIGINT))::INT AS epoch, tokens FROM o
UNION ALL
SELECT doc_id, domain, lang0, source0, epochs::INT, tokens FROM o WHERE before < rest
"""

# Lines, the four draws, the three sections and both digests.
SQL["op13_fim_assembly"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents),
d AS (
  SELECT *, len(lines)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(lines) + 1) AS x,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(lines) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(lines[1:least(x, y)], '') AS prefix,
    array_to_string(lines[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(lines[greatest(x, y) + 1:], '') AS suffix FROM d)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

# The damage draws CRC-32, written out bit by bit; the repair takes one row of every conversation a
# round and keeps the least (cost, audit, text) per state: 1 nothing yet, 2 after s, 3 after u, 4 after a.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(name) + 1),
    lambda i: [ascii(substr(name, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END),
    4294967295)"""


def _way(state: str, cost: str, edit: str, turn: str, when: str = "true") -> str:
    """The way over ``state`` made longer by an edit and, where it leaves one, a turn."""
    text = f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {turn}" if turn else f"{state}.t"
    return f"CASE WHEN {when} THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', t := {text}) END"


def _inserted(before: str, after: str) -> str:
    """Up to three empty turns put in, one at a time; texts end turns with a line break each."""
    steps = []
    for i in range(3):
        src = before if i == 0 else f"{after}{i - 1}"
        steps.append(f"""{after}{i} AS (SELECT * REPLACE (
            list_min([s3, {_way('s1', '2', 'I', "'user:'", 's1 IS NOT NULL')}, {_way('s2', '2', 'I', "'user:'", 's2 IS NOT NULL')},
                      {_way('s4', '2', 'I', "'user:'", 's4 IS NOT NULL')}]) AS s3,
            list_min([s4, {_way('s3', '2', 'I', "'assistant:'", 's3 IS NOT NULL')}]) AS s4) FROM {src})""")
    return ", ".join(steps)


def _consumed(to: str, own: str) -> str:
    """The least way to a state over one row: deleted there, or kept or reroled from before it."""
    before = {"s1": [], "s2": ["s1"], "s3": ["s1", "s2", "s4"], "s4": ["s3"]}[to]
    role = {"s2": "system", "s3": "user", "s4": "assistant"}.get(to)
    ways = [_way(to, "3", "D", "", f"{to} IS NOT NULL")]
    for b in before:
        ways.append(_way(b, "late", "K", "role || ':' || text", f"{b} IS NOT NULL AND NOT must_go AND ini = '{role[0]}'"))
        if to != "s2":
            ways.append(_way(b, "(2 + late)", "R", f"'{role}:' || text", f"{b} IS NOT NULL AND NOT must_go"))
    return f"list_min([{', '.join(ways)}]) AS {own}"


_WAY = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
SQL["op12_survivor_repair"] = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, {_CRC} % 20 AS kind FROM named),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
f AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER w AS i,
    lag(left(role, 1)) OVER w AS ini_before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    regexp_extract(text, '([^ 	-])[ 	-]*\z', 1) AS last_char
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
g AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, (fault = 'truncated')::BIGINT AS late FROM g),
step(conv_id, i, s1, s2, s3, s4) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, struct_pack(c := 0::BIGINT, a := '', t := ''), NULL::{_WAY}, NULL::{_WAY}, NULL::{_WAY}
  FROM conversations
  UNION ALL
  (WITH x AS (SELECT * FROM step), {_inserted('x', 'y')}, z AS (
     SELECT y2.conv_id, y2.i, s1, s2, s3, s4, role, text, ini, must_go, late
     FROM y2 JOIN r ON y2.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = y2.i + 1)
   SELECT conv_id, i + 1, {', '.join(_consumed(s, s) for s in ('s1', 's2', 's3', 's4'))} FROM z)),
ended AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
{_inserted('ended', 'e')},
won AS (SELECT conv_id, list_min([s1, s4]) AS best FROM e2),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT won.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(best.t) AS repaired_sha256
FROM won LEFT JOIN n ON won.conv_id IS NOT DISTINCT FROM n.conv_id
"""
