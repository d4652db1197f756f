"""The catalogue's queries as SQL, for checking. Written from the rules, not from the Spark
code: no look-around and no back-references, other algorithms where that is simpler."""

from __future__ import annotations

import re

from commentmill.functions import lexicons as lex
from commentmill.functions.text import DIGIT_LIKE, SPACE
from commentmill.plans.catalog import PHRASES, SEED, SYNONYMS, TERMS


def re2(body: str) -> str:
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", body)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


S = re2(SPACE)
WS, NWS = f"[{S}]", f"[^{S}]"
WB = r"\p{L}\p{N}_"
W, NW = f"[{WB}]", f"[^{WB}]"
P = r"[\p{P}$+<=>^`|~]"
QUOTES = re2(lex.QUOTE_GLYPHS)
INVISIBLE = re2(lex.INVISIBLE)
EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def rr(expr: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(new)}, 'g')"


def toks(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(WS + '+')}), lambda x: x <> '')"


def joined(lst: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({lst}, {q(sep)}), '')"


def strip(expr: str) -> str:
    return rr(expr, rf"\A{WS}+|{WS}+\z")


def words_in(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def sql_map(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in m.items()) + "}"


def draw(op: str, *pos: str, key: str = "doc_id") -> str:
    return "md5(concat_ws(':', " + ", ".join([q(str(SEED)), key, q(op), *pos]) + "))"


def draw_int(op: str, bound: str, *pos: str, key: str = "doc_id") -> str:
    return f"(('0x' || substr({draw(op, *pos, key=key)}, 1, 8))::UBIGINT % ({bound}))::INT"


def each(expr: str, name: str = "out", table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, {expr} AS {name} FROM {table}"


def elongations(expr: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        expr = f"regexp_replace({expr}, '{c}{{3,}}', '{c}{c}', 'g')"
    return expr


def fences(expr: str) -> str:
    return rr(rr(expr, f"[{INVISIBLE}]"), f"[{QUOTES}]{{2,}}", " ")


NOISE = {
    "strip_tags": lambda e: rr(e, "<[^>]{1,1000}[^>]{0,1000}>", " "),
    "strip_urls": lambda e: rr(e, rf"(?i)https?://{NWS}+|www\.{NWS}+", " "),
    "strip_emails": lambda e: rr(
        e, rf"{W}[{WB}.%+-]*@[{WB}.-]+\.[A-Za-z]{{2,63}}({NW}|\z)", r" \1"),
    "strip_mentions": lambda e: rr(e, f"@{W}+", " "),
    "unhash_hashtags": lambda e: rr(e, f"#({W}+)", r"\1"),
    "drop_stray_hashes": lambda e: rr(e, f"#+({W})", r" \1"),
    "strip_retweet_prefix": lambda e: rr(e, rf"(?i)\A{WS}*rt{WS}+[:@]?{WS}*", " "),
    "collapse_bangs": lambda e: rr(e, "[!?]{3,}", " "),
}

K = "doc_id::VARCHAR"
SOCIAL = (
    f"('rt : @user' || {K} || ' \u201c\u201dsee\u200b https://ex.org/p' || {K} || ' or WWW.ex.org mail bob.x' || {K} || "
    "'@mail.example.com now #topic ##deep what?!?! <b>so</b> ' || text)"
)
DISGUISED = "('S.t-u p*i_d m0r0n ' || text || ' loser''s idiots (t r a s h) $cum')"


def noise(expr: str) -> str:
    for step in NOISE.values():
        expr = step(expr)
    return expr


def chatty() -> str:
    out = "text"
    for word, short in (("the", "u"), ("and", "can't"), ("of", "GONNA"), ("de", "idk"),
                        ("la", "(isn't)"), ("der", "b/c"), ("is", "y'all")):
        out = f"replace({out}, ' {word} ', {q(' ' + short + ' ')})"
    return out


def phrases(expr: str) -> str:
    """Token by token: core, look-up, edges put back."""
    m = sql_map({**lex.SLANG, **lex.CONTRACTIONS})
    shape = rf"^({NW}*)([{WB}']+)({NW}*)$"
    core = f"lower(regexp_extract(x, {q(shape)}, 2))"
    new = (f"CASE WHEN regexp_matches(x, {q(shape)}) AND map_contains(m, {core}) THEN "
           f"regexp_extract(x, {q(shape)}, 1) || m[{core}] || regexp_extract(x, {q(shape)}, 3) "
           "ELSE x END")
    new = new.replace("m[", f"{m}[").replace("map_contains(m,", f"map_contains({m},")
    return joined(f"list_transform(regexp_extract_all({expr}, {q(WS + '+|' + NWS + '+')}), "
                  f"lambda x: {new})", "")


def phrase_table() -> str:
    """Pieces unnested with their place, joined with the words, joined again in order."""
    shape = rf"^({NW}*)([{WB}']+)({NW}*)$"
    part = [f"regexp_extract(x, {q(shape)}, {i})" for i in (1, 2, 3)]
    return f"""WITH words AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token FROM documents),
      known AS (SELECT token, '<' || token || ' ' || length(token) || '>' AS phrase FROM words WHERE length(token) >= 4),
      pieces AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id,
        regexp_extract_all(coalesce(text, ''), {q(WS + '+|' + NWS + '+')}) AS l FROM documents)),
      cores AS (SELECT *, CASE WHEN regexp_matches(x, {q(shape)}) THEN lower({part[1]}) END AS core FROM pieces),
      mapped AS (SELECT doc_id, i, CASE WHEN phrase IS NULL THEN x ELSE {part[0]} || phrase || {part[2]} END AS y
        FROM cores LEFT JOIN known ON core = token),
      built AS (SELECT doc_id, string_agg(y, '' ORDER BY i) AS t FROM mapped GROUP BY doc_id)
      SELECT doc_id, md5(coalesce(t, '')) AS processed_text FROM documents LEFT JOIN built USING (doc_id)"""


def stopwords(expr: str) -> str:
    return joined(f"list_filter({toks(expr)}, lambda x: lower(x) NOT IN {words_in(lex.STOP_WORDS)})")


def squeeze(expr: str) -> str:
    return f"trim({rr(expr, WS + '+', ' ')}, ' ')"


def configured(expr: str) -> str:
    e = elongations(noise(fences(expr)))
    e = phrases(f"lower({e})")
    e = rr(rr(e, P), r"\p{Nd}+")
    return squeeze(stopwords(e))


# --- statistics ---


def measures(expr: str) -> dict[str, str]:
    t = expr
    solid, punct = f"length({rr(t, WS)})", f"(length({t}) - length({rr(t, P)}))"
    lowered = f"list_transform({toks(t)}, lambda x: regexp_replace(lower(x), {q(EDGES)}, '', 'g'))"
    chars = f"string_split({t}, '')"
    triple = (f"len(list_filter(list_zip({chars}, ({chars})[2:], ({chars})[3:]), "
              "lambda z: z[1] = z[2] AND z[2] = z[3] AND z[1] <> chr(10))) > 0")
    return {
        "messy_whitespace": f"regexp_matches({t}, {q(WS + '{2,}|' + chr(10) + '|' + chr(9))})",
        "url_like": rf"regexp_matches({t}, '(?i)https?://|www\.')",
        "mention": f"regexp_matches({t}, {q('@' + W)})",
        "angle_tag": f"regexp_matches({t}, '<[^>]{{1,1000}}[^>]{{0,1000}}>')",
        "elongation": triple,
        "quote_fence": f"regexp_matches({t}, {q('[' + QUOTES + ']{2,}')})",
        "punctuation_only": f"({solid} > 0 AND {punct} = {solid})",
        "heavy_punctuation": f"({solid} >= 4 AND {punct} >= 4 AND {punct}::DOUBLE / greatest({solid}, 1) >= 0.30)",
        "repeated_punctuation": f"regexp_matches({t}, {q(f'[^{WB}{S}]' + '{3,}')})",
        "slang_hint": f"list_has_any({lowered}, [{', '.join(map(q, lex.SLANG_HINTS))}])",
    }


_FLAG_OF = {
    "messy_whitespace_ratio": "messy_whitespace", "rows_with_url_like": "url_like",
    "rows_with_mentions": "mention", "rows_with_html_angle_tags": "angle_tag",
    "rows_with_char_elongations": "elongation", "rows_with_multi_quote_fences": "quote_fence",
    "rows_with_punctuation_only": "punctuation_only",
    "rows_with_heavy_punctuation": "heavy_punctuation",
    "rows_with_repeated_punctuation": "repeated_punctuation",
    "rows_with_slang_hint_tokens": "slang_hint",
}


def statistics() -> str:
    d = re2(DIGIT_LIKE)
    shares = {
        "uppercase_ratio": rf"(length(text) - length({rr('text', '[' + chr(92) + 'p{Lu}]')}))",
        "punctuation_ratio": f"(length(text) - length({rr('text', P)}))",
        "digit_ratio": f"(length(text) - length({rr('text', '[' + d + ']')}))",
        "non_ascii_ratio": rf"(length(text) - length({rr('text', '[^' + chr(92) + 'x00-' + chr(92) + 'x7f]')}))",
    }
    parts = [f"sum({e})::DOUBLE / greatest(sum(length(text)), 1) AS {n}" for n, e in shares.items()]
    parts.append(f"coalesce(avg(len(list_filter({toks('text')}, lambda x: lower(x) IN "
                 f"{words_in(lex.STOP_WORDS)}))::DOUBLE / nullif(len({toks('text')}), 0)), 0) "
                 "AS avg_stopword_ratio")
    flags = measures("text")
    parts += [f"avg(CASE WHEN {flags[f]} THEN 1.0 ELSE 0.0 END) AS {n}" for n, f in _FLAG_OF.items()]
    return f"SELECT count(*) AS n_rows, {', '.join(parts)} FROM documents"


def rounded_statistics() -> str:
    names = ["uppercase_ratio", "punctuation_ratio", "digit_ratio", "non_ascii_ratio",
             "avg_stopword_ratio", *_FLAG_OF]
    return f"SELECT n_rows, {', '.join(f'round({n}, 8) AS {n}' for n in names)} FROM ({statistics()})"


DECISIONS = {
    "lowercase": "uppercase_ratio > 0.08",
    "remove_punctuation": "punctuation_ratio > 0.05 OR rows_with_punctuation_only >= 0.005 OR "
                          "rows_with_heavy_punctuation >= 0.02 OR rows_with_repeated_punctuation >= 0.02",
    "remove_stopwords": "avg_stopword_ratio > 0.35",
    "remove_numbers": "digit_ratio > 0.03",
    "normalize_whitespace": "messy_whitespace_ratio > 0.20",
    "normalize_unicode": "non_ascii_ratio > 0.015",
    "remove_noise": "rows_with_url_like > 0.02 OR rows_with_mentions > 0.03 OR "
                    "rows_with_html_angle_tags > 0.02 OR rows_with_multi_quote_fences > 0.015",
    "reduce_elongations": "rows_with_char_elongations > 0.06",
    "map_slang": "rows_with_slang_hint_tokens > 0.12",
    "expand_contractions": "rows_with_slang_hint_tokens > 0.08",
}

# --- profanity ---

SUFFIX = "(?:s|es|ed|ing|er|ers|y|ies)?"


def undisguise(expr: str) -> str:
    plain = f"translate(lower({expr}), {q(lex.LOOKALIKE_FROM)}, {q(lex.LOOKALIKE_TO)})"
    return f"trim({rr(plain, '[^a-z0-9]+', ' ')}, ' ')"


def scan_cte(source: str, key: str, terms: list[str], text: str = "text", more: str = "") -> str:
    """hits(key, n, matches): whole words that are a term plus a suffix, raw text first."""
    full = f"^({'|'.join(terms)}){SUFFIX}$"
    word = q(W + "+")
    return (
        f"src AS (SELECT {key} AS k, {text} AS t{more} FROM {source}), "
        f"words AS (SELECT k, 1 AS pass, generate_subscripts(a, 1) AS pos, unnest(a) AS w FROM "
        f"(SELECT k, regexp_extract_all(t, {word}) AS a FROM src) UNION ALL "
        f"SELECT k, 2, generate_subscripts(a, 1), unnest(a) FROM "
        f"(SELECT k, regexp_extract_all({undisguise('t')}, {word}) AS a FROM src)), "
        f"terms AS (SELECT k, regexp_extract(lower(w), {q(full)}, 1) AS term, min((pass, pos)) AS seen "
        f"FROM words WHERE regexp_matches(lower(w), {q(full)}) GROUP BY ALL), "
        "hits AS (SELECT k, count(*)::INT AS n, string_agg(term, ', ' ORDER BY seen) AS m FROM terms GROUP BY k) "
    )


LARGE = """WITH terms AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t
      FROM documents) WHERE length(t) = 8),
    forms AS (SELECT t || s AS form, min(t) AS term FROM terms, (SELECT unnest(
      ['', 's', 'es', 'ed', 'ing', 'er', 'ers', 'y', 'ies']) AS s) GROUP BY ALL)"""


def scan_large() -> str:
    """Words of both passes joined with the forms of the terms."""
    parts = [f"SELECT doc_id, {i} AS pass, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, "
             f"regexp_extract_all({t}, {q(W + '+')}) AS a FROM documents)"
             for i, t in enumerate(("lower(text)", undisguise("text")))]
    return (f"{LARGE}, words AS ({' UNION ALL '.join(parts)}), "
            "found AS (SELECT doc_id, term, min((pass, pos)) AS seen FROM words JOIN forms ON w = form GROUP BY ALL), "
            "hits AS (SELECT doc_id, count(*)::INT AS n, string_agg(term, ',' ORDER BY seen) AS m FROM found GROUP BY ALL) "
            "SELECT doc_id, coalesce(n, 0) AS profanity_count, md5(coalesce(m, '')) AS matches "
            "FROM documents LEFT JOIN hits USING (doc_id)")


def sanitize_large() -> str:
    """Spelt words are terms; one that the row has as a whole word stays as it is spelt."""
    return f"""{LARGE}, words AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id,
        regexp_extract_all(lower(text), '[a-z]+') AS a FROM documents)),
      marked AS (SELECT *, length(w) = 8 AND (pos - 1) % 3 = 0 AS spelt FROM words),
      whole AS (SELECT doc_id, pos, term FROM marked JOIN forms ON w = form WHERE NOT spelt),
      first AS (SELECT doc_id, term, min(pos) AS seen FROM whole GROUP BY ALL),
      apart AS (SELECT DISTINCT doc_id, w AS term FROM marked WHERE spelt AND (doc_id, w) NOT IN (SELECT doc_id, term FROM first)),
      listed AS (SELECT doc_id, string_agg(term, ',' ORDER BY grp, seen, term) AS m FROM (SELECT doc_id, term, 0 AS grp, seen
        FROM first UNION ALL SELECT doc_id, term, 1, 0 FROM apart) GROUP BY doc_id),
      out AS (SELECT m.doc_id, m.pos, CASE WHEN h.term IS NOT NULL OR a.term IS NOT NULL THEN {q(lex.MASK_TOKEN)}
          WHEN spelt THEN array_to_string(regexp_extract_all(w, '.'), '.') ELSE w END AS y
        FROM marked m LEFT JOIN whole h ON h.doc_id = m.doc_id AND h.pos = m.pos
        LEFT JOIN apart a ON a.doc_id = m.doc_id AND a.term = m.w AND m.spelt),
      built AS (SELECT doc_id, string_agg(y, ' 0 ' ORDER BY pos) AS t FROM out GROUP BY doc_id)
      SELECT doc_id, md5(coalesce(t, '')) AS clean_text, md5(coalesce(m, '')) AS replacements
      FROM documents LEFT JOIN built USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def mask_once(expr: str, term_rx: str, new: str) -> str:
    """Replace boundary-to-boundary; twice, since a neighbour may share the separator."""
    rx = f"(?i)(^|{NW}){term_rx}({NW}|$)"
    return rr(rr(expr, rx, rf"\1{new}\2"), rx, rf"\1{new}\2")


def sanitize_sql(phrase: dict[str, str]) -> str:
    terms = sorted(TERMS)
    suffix = "(?:'s|s|es|ed|ing|er|ers|y|ies)?"
    new = {t: phrase.get(t, lex.MASK_TOKEN) for t in terms}
    direct = DISGUISED
    for t in terms:
        direct = mask_once(direct, f"(?:{t}){suffix}", new[t])
    full = f"^({'|'.join(terms)}){SUFFIX}$"
    word = f"regexp_extract_all({DISGUISED}, {q(W + '+')})"
    first = (f"list_transform(list_filter({word}, lambda x: regexp_matches(lower(x), {q(full)})), "
             f"lambda x: regexp_extract(lower(x), {q(full)}, 1))")
    order = (f"list_transform(list_sort(list_transform(list_distinct({first}), lambda y: "
             f"(list_position({first}, y), y))), lambda p: p[2])")
    sql = f"WITH s0 AS (SELECT doc_id, {direct} AS o, {order} AS f FROM documents)"
    for i, t in enumerate(terms, 1):
        gap = r"[^\p{L}\p{N}]*"
        rx = f"(?i)(^|{NW}){gap.join(t)}({NW}|$)"
        todo = f"(NOT list_contains(f, {q(t)}) AND regexp_matches(o, {q(rx)}))"
        sql += (f", s{i} AS (SELECT doc_id, CASE WHEN {todo} THEN "
                f"{mask_once('o', gap.join(t), new[t])} ELSE o END AS o, "
                f"CASE WHEN {todo} THEN list_append(f, {q(t)}) ELSE f END AS f FROM s{i - 1})")
    return sql + f" SELECT doc_id, o AS clean_text, {joined('f', ', ')} AS clean_replacements FROM s{len(terms)}"


# --- augmentation ---

TOKS = f"toks AS (SELECT doc_id, text, {toks('text')} AS a FROM documents)"


def synonym_sql(op: str = "synonym", share: str = "0.1", source: str = TOKS,
                out: str = "out") -> str:
    """k lowest hashes by rank; each such token takes one of its sorted synonyms."""
    pairs = ", ".join(f"({q(w)}, [{', '.join(map(q, sorted(s)))}])" for w, s in SYNONYMS.items())
    pick = draw_int(op + ".pick", "len(options)", "pos - 1", key="doc_id")
    return (
        f"WITH {source}, syn(word, options) AS (VALUES {pairs}), "
        "long AS (SELECT doc_id, text, len(a) AS n, generate_subscripts(a, 1) AS pos, unnest(a) AS tok FROM toks), "
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {draw(op, 'pos - 1')}) AS rk FROM long), "
        f"picked AS (SELECT r.*, CASE WHEN rk <= greatest(1, floor(n * {share})) AND options IS NOT NULL "
        f"THEN options[{pick} + 1] ELSE tok END AS new FROM ranked r LEFT JOIN syn "
        f"ON word = lower(regexp_replace(tok, {q(EDGES)}, '', 'g'))), "
        "done AS (SELECT doc_id, string_agg(new, ' ' ORDER BY pos) AS o FROM picked GROUP BY doc_id) "
        f"SELECT t.doc_id, CASE WHEN len(a) < 2 THEN text ELSE o END AS {out} FROM toks t LEFT JOIN done USING (doc_id)"
    )


def swap_sql(share: str = "0.1", op: str = "swap", source: str = "documents",
             out: str = "out") -> str:
    """Swaps one after the other, as a fold over the swap list."""
    a = draw_int(op, "n", "j || ':a'")
    b = draw_int(op, "n - 1", "j || ':b'")
    return (
        f"WITH toks AS (SELECT doc_id, text, {toks('text')} AS a FROM {source}), base AS (SELECT doc_id, text, a, len(a) AS n, "
        f"greatest(1, floor(len(a) * {share}))::INT AS k FROM toks), "
        f"draws AS (SELECT doc_id, j, {a} AS x, {b} AS y0 FROM (SELECT doc_id, n, unnest(range(k)) AS j FROM base WHERE n >= 2)), "
        "pairs AS (SELECT doc_id, list([(x + 1)::VARCHAR, (y0 + CASE WHEN y0 >= x THEN 1 ELSE 0 END + 1)::VARCHAR] ORDER BY j) AS ps "
        "FROM draws GROUP BY doc_id), "
        "done AS (SELECT doc_id, list_reduce(ps, lambda acc, p: list_transform(acc, lambda t, i: "
        "CASE WHEN i = p[1]::INT THEN acc[p[2]::INT] WHEN i = p[2]::INT THEN acc[p[1]::INT] ELSE t END), a) AS r "
        "FROM pairs JOIN base USING (doc_id)) "
        "SELECT b.doc_id, CASE WHEN n < 2 THEN text ELSE array_to_string(r, ' ') END AS " + out + " FROM base b LEFT JOIN done USING (doc_id)"
    )


def insertion_sql(out: str = "out") -> str:
    """Insertions one after the other: a recursive walk over the insert number."""
    pairs = ", ".join(f"({q(w)}, [{', '.join(map(q, sorted(s)))}])" for w, s in SYNONYMS.items())
    base = draw_int("insert", "len(a)", "j || ':base'")
    gap = draw_int("insert", "len(a) + 1", "j || ':gap'")
    pick = draw_int("insert", "len(options)", "j || ':pick'")
    word = f"lower(regexp_replace(a[{base} + 1], {q(EDGES)}, '', 'g'))"
    new = f"CASE WHEN options IS NULL THEN a[{base} + 1] ELSE options[{pick} + 1] END"
    return (
        f"WITH RECURSIVE {TOKS}, syn(word, options) AS (VALUES {pairs}), "
        "walk(doc_id, a, j, k) AS (SELECT doc_id, a, 0, greatest(1, floor(len(a) * 0.1))::INT FROM toks WHERE len(a) > 0 "
        f"UNION ALL SELECT doc_id, a[1:{gap}] || [{new}] || a[{gap} + 1:], j + 1, k "
        f"FROM walk LEFT JOIN syn ON word = {word} WHERE j < k) "
        f"SELECT doc_id, array_to_string(a, ' ') AS {out} FROM walk WHERE j = k "
        "UNION ALL SELECT doc_id, text FROM toks WHERE len(a) = 0"
    )


DELETION = (
    f"WITH {TOKS}, h AS (SELECT *, list_transform(a, lambda x, i: {draw('delete', 'i - 1')}) AS hs FROM toks), "
    "kept AS (SELECT *, list_filter(a, lambda x, i: hs[i] > '19999999') AS f FROM h) "
    "SELECT doc_id, CASE WHEN len(a) <= 2 THEN text WHEN len(f) = 0 THEN a[list_position(hs, list_max(hs))] "
    "ELSE array_to_string(f, ' ') END AS out FROM kept"
)
BACK = (
    f"WITH {TOKS} SELECT doc_id, CASE WHEN len(a) <= 3 THEN text ELSE array_to_string("
    "a[1:1] || list_reverse(a[2:len(a) - 1]) || a[len(a):], ' ') END AS out FROM toks"
)
CROP = (
    f"WITH {TOKS} SELECT doc_id, CASE WHEN len(a) <= 4 THEN text ELSE array_to_string("
    "a[1:len(a) - greatest(1, floor(len(a) * 0.1))::INT], ' ') END AS out FROM toks"
)
SHUFFLE = (
    "WITH s AS (SELECT doc_id, text, list_filter(string_split("
    + rr(strip("text"), rf"([.!?]){WS}+", "\\1\x01")
    + ", chr(1)), lambda x: x <> '') AS a FROM documents) "
    "SELECT doc_id, CASE WHEN len(a) < 2 THEN text ELSE array_to_string(list_transform(list_sort("
    f"list_transform(a, lambda x, i: ({draw('sentence', 'i - 1')}, i, x))), lambda p: p[3]), ' ') END AS out FROM s"
)
NOISE_INJECTION = (
    "WITH c AS (SELECT doc_id, text, string_split(text, '') AS a, greatest(1, floor(length(text) * 0.08))::INT AS k FROM documents), "
    f"d AS (SELECT doc_id, j, {draw_int('noise.at', 'n', 'j')} AS place, {draw_int('noise.letter', '26', 'j')} AS l "
    "FROM (SELECT doc_id, len(a) AS n, unnest(range(k)) AS j FROM c)), "
    "lastd AS (SELECT doc_id, place, arg_max(l, j) AS l FROM d GROUP BY ALL), "
    "ch AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS ch FROM c) "
    f"SELECT ch.doc_id, string_agg(CASE WHEN l IS NULL OR regexp_matches(ch, {q(WS)}) THEN ch "
    "ELSE substr('abcdefghijklmnopqrstuvwxyz', l + 1, 1) END, '' ORDER BY pos) AS out "
    "FROM ch LEFT JOIN lastd ON ch.doc_id = lastd.doc_id AND place = pos - 1 GROUP BY ch.doc_id"
)
SYNONYM_TABLE = (
    "WITH src AS (SELECT doc_id, concat_ws(' ', 'nation_' || doc_id % 25, text, 'nation_' || doc_id % 25) AS text FROM documents), "
    f"toks AS (SELECT doc_id, text, {toks('text')} AS a FROM src), "
    "syn AS (SELECT lower(n_name) AS word, list_sort(list(DISTINCT replace(lower(r_name), '_', ' '))) AS options "
    "FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1), "
    "long AS (SELECT doc_id, len(a) AS n, generate_subscripts(a, 1) AS pos, unnest(a) AS tok FROM toks), "
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {draw('synonym', 'pos - 1')}) AS rk FROM long), "
    "picked AS (SELECT r.*, CASE WHEN rk <= greatest(1, floor(n * 0.5)) AND options IS NOT NULL "
    f"THEN options[{draw_int('synonym.pick', 'len(options)', 'pos - 1')} + 1] ELSE tok END AS new FROM ranked r "
    f"LEFT JOIN syn ON word = lower(regexp_replace(tok, {q(EDGES)}, '', 'g'))) "
    "SELECT doc_id, string_agg(new, ' ' ORDER BY pos) AS out FROM picked GROUP BY doc_id"
)

# --- profiles ---


def profile_sql(table: str, cols: list[tuple[str, bool]], text: str) -> str:
    """cols: (name, is text). Role label: fewest values within the limits, first wins."""
    lines = []
    for i, (c, is_text) in enumerate(cols):
        mean = f"(SELECT avg(length(coalesce({c}, ''))) FROM {table})" if is_text else "NULL::DOUBLE"
        lines.append(f"SELECT {i} AS position, {q(c)} AS \"column\", {mean} AS m, "
                     f"(SELECT count(DISTINCT {c}) FROM {table}) AS n")
    return (
        f"WITH p AS ({' UNION ALL '.join(lines)}), lim AS (SELECT least(50, greatest(2, floor(count(*) * 0.3))) AS top FROM {table}), "
        f"lab AS (SELECT arg_min(position, (n, position)) AS l FROM p, lim WHERE \"column\" <> {q(text)} AND n BETWEEN 2 AND top) "
        "SELECT position::INT AS position, \"column\", round(m, 6) AS mean_length, CASE WHEN n <= 50 THEN n END AS n_values, "
        f"CASE WHEN \"column\" = {q(text)} THEN 'text' WHEN position = l THEN 'label' ELSE '' END AS role FROM p, lab"
    )


VERDICT = "(count(*) > 0 AND NOT (count(*) >= 20 AND count(DISTINCT {y})::DOUBLE / count(*) >= 0.85))"
PAIRS = (
    "WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)) "
    f"SELECT 'text' AS text_col, 'toxic' AS label_col, {VERDICT.format(y='toxic')} AS ok FROM d UNION ALL "
    "SELECT 'text', 'text', false UNION ALL "
    f"SELECT 'text', 'doc_id', {VERDICT.format(y='doc_id')} FROM d UNION ALL "
    f"SELECT 'text', 'lang', {VERDICT.format(y='lang')} FROM d"
)



def configured_chain() -> str:
    """All nine steps, each over the one before."""
    steps = [synonym_sql(), insertion_sql(), swap_sql(), DELETION, BACK,
             synonym_sql("paraphrase.synonym", "0.15"), swap_sql("0.05", "paraphrase.swap"), SHUFFLE, CROP,
             NOISE_INJECTION]
    names = [f"step{i}" for i in range(len(steps))]
    parts, source = [], "documents"
    for name, sql in zip(names, steps, strict=True):
        parts.append(f"{name} AS MATERIALIZED (SELECT doc_id, out AS text FROM ({sql.replace('FROM documents', f'FROM {source}')}))")
        source = name
    return f"WITH {', '.join(parts)} SELECT doc_id, text AS augmented_text FROM {source}"


# Test rows per class by largest remainder; a missing label is a class.
MISSING_LABELS = (
    "WITH c AS (SELECT coalesce(CASE WHEN doc_id % 4 <> 0 THEN toxic END::VARCHAR, '') AS label, count(*) AS rows "
    "FROM labels GROUP BY 1), t AS (SELECT sum(rows) AS n, ceil(sum(rows) * 0.2) AS n_test FROM c), "
    "e AS (SELECT label, rows, rows * n_test / n AS exact FROM c, t), "
    "r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, label) AS place, "
    "(SELECT n_test FROM t) - sum(floor(exact)) OVER () AS short FROM e), "
    "q AS (SELECT label, rows, (floor(exact) + CASE WHEN place <= short THEN 1 ELSE 0 END)::BIGINT AS quota FROM r) "
    "SELECT label, true AS is_test, quota AS n FROM q WHERE quota > 0 "
    "UNION ALL SELECT label, false, rows - quota FROM q WHERE rows > quota"
)

# --- metrics ---

JUDGED = (
    "WITH " + scan_cte("documents", "doc_id", TERMS)
    + ", j AS (SELECT l.toxic::VARCHAR AS y, (CASE WHEN n > 0 THEN 1 ELSE 0 END)::VARCHAR AS p "
      "FROM labels l JOIN documents d USING (doc_id) LEFT JOIN hits ON k = l.doc_id), "
      "c AS (SELECT c, sum((y = c)::INT) AS support, sum((p = c)::INT) AS predicted, sum((y = c AND p = c)::INT) AS hits "
      "FROM j, (SELECT DISTINCT y AS c FROM j UNION SELECT DISTINCT p FROM j) GROUP BY c), "
      "f AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, "
      "coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM c) "
)
REPORT = (
    JUDGED + "SELECT 'class' AS section, c AS name, round(precision, 4) AS precision, round(recall, 4) AS recall, "
    "round(f1, 4) AS f1, support::BIGINT AS support FROM f UNION ALL "
    "SELECT 'summary', 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 4), sum(support)::BIGINT FROM f UNION ALL "
    "SELECT 'summary', 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM f UNION ALL "
    "SELECT 'summary', 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4), "
    "round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM f"
)


def exact_split(table: str, key: str, label: str) -> str:
    """Largest-remainder quotas, then the lowest hashes of each class."""
    h = f"{draw('split', key=key)} || ':' || {key}"
    return (
        f"WITH r AS (SELECT *, {label}::VARCHAR AS lab, {h} AS h FROM {table}), "
        "c AS (SELECT lab, count(*) AS n FROM r GROUP BY lab), t AS (SELECT sum(n) AS n, ceil(sum(n) * 0.2) AS want FROM c), "
        "e AS (SELECT lab, c.n * want / t.n AS x FROM c, t), "
        "fl AS (SELECT lab, floor(x) AS base, row_number() OVER (ORDER BY x - floor(x) DESC, lab) AS rk, "
        "(SELECT want FROM t) - sum(floor(x)) OVER () AS short FROM e), "
        "quo AS (SELECT lab, base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS quota FROM fl), "
        "s AS (SELECT r.*, row_number() OVER (PARTITION BY r.lab ORDER BY h) <= quota AS is_test FROM r JOIN quo USING (lab)) "
    )


# --- features and neighbours ---

GRAMS = (
    "ws AS (SELECT doc_id, regexp_extract_all(lower(text), " + q(W + "{2,}") + ") AS w FROM {src}), "
    "grams AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM ws), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL) "
)
VOCAB = ("SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM {tf} GROUP BY term "
         "ORDER BY total DESC, term LIMIT 50000")
# Multinomial naive Bayes in closed form, smoothing 1; a tie goes to the commoner class.
BAYES = (
    exact_split("(SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id))", "doc_id", "toxic") + ", "
    + GRAMS.replace("{src}", "documents")
    + ", tr AS (SELECT tf.* FROM tf JOIN s USING (doc_id) WHERE NOT is_test), "
      "nn AS (SELECT count(*) AS n FROM s WHERE NOT is_test), "
    + f"voc AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM ({VOCAB.replace('{tf}', 'tr')}), nn), "
      "v AS (SELECT doc_id, term, tf * idf AS v FROM tf JOIN voc USING (term)), "
      "w AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS w FROM v), "
      "sums AS (SELECT lab, term, sum(w) AS f FROM w JOIN s USING (doc_id) WHERE NOT is_test GROUP BY ALL), "
      "k AS (SELECT lab, ln((count(*) + 1) / ((SELECT n FROM nn) + (SELECT count(DISTINCT lab) FROM s))) AS prior, "
      "(SELECT sum(f) FROM sums WHERE sums.lab = s.lab) + (SELECT count(*) FROM voc) AS mass, "
      "row_number() OVER (ORDER BY count(*) DESC, lab) AS place FROM s WHERE NOT is_test GROUP BY lab), "
      "p AS (SELECT d.doc_id, k.lab, any_value(place) AS place, any_value(prior) "
      "+ coalesce(sum(w.w * (ln(coalesce(x.f, 0) + 1) - ln(mass))), 0) AS score FROM documents d CROSS JOIN k "
      "LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN sums x ON x.lab = k.lab AND x.term = w.term GROUP BY d.doc_id, k.lab), "
      "best AS (SELECT doc_id, arg_min(lab, (-round(score, 9), place)) AS prediction_label FROM p GROUP BY doc_id) "
)
KNN = (
    f"WITH lab AS (SELECT doc_id, text, toxic, {draw('split')} < '33333333' AS is_test FROM documents JOIN labels USING (doc_id)), "
    + GRAMS.replace("{src}", "lab")
    + ", tr AS (SELECT tf.* FROM tf JOIN lab USING (doc_id) WHERE NOT is_test), "
      "nn AS (SELECT count(*) AS n FROM lab WHERE NOT is_test), "
    + f"voc AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM ({VOCAB.replace('{tf}', 'tr')}), nn), "
      "v AS (SELECT doc_id, term, tf * idf AS v FROM tf JOIN voc USING (term)), "
      "w AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS w FROM v), "
      "sim AS (SELECT a.doc_id AS te, b.doc_id AS tn, round(sum(a.w * b.w), 9) AS s FROM w a JOIN w b USING (term) "
      "JOIN lab la ON la.doc_id = a.doc_id AND la.is_test JOIN lab lb ON lb.doc_id = b.doc_id AND NOT lb.is_test GROUP BY 1, 2), "
      "pairs AS (SELECT te.doc_id AS te, tn.doc_id AS tn, tn.toxic AS y, coalesce(s, 0) AS s FROM lab te JOIN lab tn "
      "ON te.is_test AND NOT tn.is_test LEFT JOIN sim ON sim.te = te.doc_id AND sim.tn = tn.doc_id), "
      "near AS (SELECT *, row_number() OVER (PARTITION BY te ORDER BY s DESC, tn) AS rk FROM pairs), "
      "votes AS (SELECT te, y::VARCHAR AS y, count(*) AS n FROM near WHERE rk <= 7 GROUP BY ALL) "
      "SELECT te AS doc_id, arg_min(y, (-n, y)) AS prediction_label FROM votes GROUP BY te"
)

# --- scoring ---

ITEMS = (
    f"items AS (SELECT doc_id AS row_id, {strip('text')} AS raw, {squeeze(fences(strip('text')))} AS txt FROM documents "
    f"WHERE {strip('text')} <> ''), full_items AS (SELECT * FROM items WHERE txt <> '')"
)
PACK = (
    f"WITH RECURSIVE {ITEMS}, cost AS (SELECT floor((row_id - 1) / 128.0)::BIGINT AS chunk, row_id, "
    f"len(regexp_extract_all(txt, {q(W + '+|' + f'[^{WB}{S}]')})) + 16 AS c FROM full_items), "
    "seq AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY row_id) AS i FROM cost), "
    "walk(chunk, i, row_id, n, t, b) AS (SELECT chunk, i, row_id, 1, c, 0 FROM seq WHERE i = 1 UNION ALL "
    "SELECT s.chunk, s.i, s.row_id, CASE WHEN t + c > 2000 OR n >= 8 THEN 1 ELSE n + 1 END, "
    "CASE WHEN t + c > 2000 OR n >= 8 THEN c ELSE t + c END, CASE WHEN t + c > 2000 OR n >= 8 THEN b + 1 ELSE b END "
    "FROM walk JOIN seq s ON s.chunk = walk.chunk AND s.i = walk.i + 1) "
    "SELECT row_id, chunk || '.' || b AS batch_id FROM walk"
)
# A row with the faulty score never becomes valid; every other row does, at the latest alone.
RESULTS = (
    f"WITH {ITEMS}, " + scan_cte("full_items", "row_id", TERMS, "txt", ", raw, row_id")
    + ", scored AS (SELECT src.row_id, raw, coalesce(n, 0) AS h, least(100, 35 * coalesce(n, 0)) AS overall, "
      "least(100, 30 * coalesce(n, 0)) AS toxicity, least(100, 10 * coalesce(n, 0)) AS severe_toxicity, 0 AS identity_attack, "
      "least(100, 35 * coalesce(n, 0)) AS insult, 0 AS profanity, 0 AS threat, src.row_id % 10 = 7 AS failed FROM src LEFT JOIN hits USING (k)), "
      "ok AS (SELECT * FROM scored WHERE NOT failed) "
)
PREVIEW = "substr(translate(raw, chr(10) || chr(9), '  '), 1, 180)"
SIX = ["toxicity", "severe_toxicity", "identity_attack", "insult", "profanity", "threat"]
LINE = "'Overall: ' || overall || '%' || " + " || ".join(
    f"' | {lex.SCORE_TITLES[c]}: ' || {c} || '%'" for c in SIX)


def report_sql() -> str:
    """Facts, the five highest rows, the first twenty failed rows and how many are left, one line each."""
    means = ["overall", *SIX]
    titles = ["overall score", *(c.replace("_", " ") for c in SIX)]
    facts = [("source", "'documents'"), ("text in", "'text'"), ("state", "'Completed'"),
             ("rows chosen", "n_all"), ("scored", "analyzed"), ("blank", "skipped"),
             ("emptied by cleaning", "emptied"), ("failed", "errors"), ("toxic", "n_toxic"),
             ("not toxic", "analyzed - n_toxic"),
             *((f"mean of {t}", f"{c} || '%'") for t, c in zip(titles, means, strict=True))]
    lines = ", ".join(f"'* {k} = ' || ({v})" for k, v in facts)
    return RESULTS + (
        ", facts AS (SELECT (SELECT count(*) FROM documents) AS n_all, count(*) AS analyzed, "
        f"(SELECT count(*) FROM documents WHERE {strip('text')} = '') AS skipped, "
        "(SELECT count(*) FROM items WHERE txt = '') AS emptied, (SELECT count(*) FROM scored WHERE failed) AS errors, "
        "count(*) FILTER (overall >= 20) AS n_toxic, "
        + ", ".join(f"round_even(avg({c}), 0)::INT AS avg_{c}" for c in means) + " FROM ok), "
        "named AS (SELECT n_all, analyzed, skipped, emptied, errors, n_toxic, "
        + ", ".join(f"avg_{c} AS {c}" for c in means) + " FROM facts), "
        f"best AS (SELECT row_id, overall, '* row ' || row_id || ' at ' || overall || '%: ' || {PREVIEW} AS l FROM ok "
        "WHERE overall > 0 ORDER BY overall DESC, row_id LIMIT 5), "
        "lost AS (SELECT row_id, '* row ' || row_id || ': score ''overall_score'' is missing or not a whole number 0-100' AS l "
        "FROM scored WHERE failed ORDER BY row_id LIMIT 20) "
        f"SELECT analyzed, {LINE} AS scores_line, concat_ws(chr(10), {LINE}, 'Scores of the dataset', "
        + lines + ", (SELECT 'Highest rows' || chr(10) || string_agg(l, chr(10) ORDER BY overall DESC, row_id) FROM best), "
        "(SELECT 'Failed rows' || chr(10) || string_agg(l, chr(10) ORDER BY row_id) FROM lost), "
        "CASE WHEN errors > 20 THEN '* and ' || (errors - 20) || ' more' END) AS report FROM named")


_KIND = "doc_id % 6"
_N = "length(text) % 101"
PARSED = (
    "WITH a AS (SELECT doc_id, doc_id % 6 AS kind, (length(text) % 101)::INT AS n FROM documents) "
    "SELECT doc_id, CASE WHEN kind < 5 THEN doc_id END AS row_id, kind = 5 AS unreadable, kind >= 3 AS invalid, "
    "CASE WHEN kind < 3 THEN n END AS overall_score, CASE WHEN kind < 5 THEN n END AS toxicity, "
    "CASE WHEN kind = 1 THEN 7 WHEN kind < 5 THEN 1 END AS severe_toxicity, "
    "CASE kind WHEN 0 THEN 'Profanity|Racism' WHEN 1 THEN 'Violence|Threats' WHEN 2 THEN 'Violence' ELSE 'None' END AS category, "
    "CASE kind WHEN 0 THEN 'High' WHEN 4 THEN 'Severe' ELSE 'Low' END AS toxicity_level, "
    "CASE kind WHEN 0 THEN 'Threat|Insult' WHEN 1 THEN 'Bullying|Identity Attack' WHEN 2 THEN 'Graphic Violence|Insult' ELSE '' END AS toxicity_type "
    "FROM a"
)
SINGLE = (
    "WITH a AS (SELECT doc_id, doc_id % 4 AS kind, (length(text) % 101)::VARCHAR AS n FROM documents) "
    "SELECT doc_id, CASE WHEN kind < 2 THEN n END AS overall, "
    "CASE kind WHEN 1 THEN 'Racism|Threats|None' WHEN 2 THEN 'Racism|Threats' ELSE 'None' END AS category, "
    "CASE kind WHEN 0 THEN 'Low' WHEN 2 THEN 'High' END AS level, "
    "CASE kind WHEN 2 THEN 'said \"so\" twice' END AS explanation, false AS echo FROM a"
)

# --- history ---

RUNS = (
    "WITH runs AS (SELECT event_id AS id, user_id, event_type AS run_type, floor(value)::BIGINT AS row_count, "
    "floor(floor(value) / 3)::BIGINT AS toxic_count, (floor(value) - floor(floor(value) / 3))::BIGINT AS non_toxic_count, "
    "CASE WHEN event_id % 2 = 0 THEN 'Overall: ' ELSE 'Run ' END || props || chr(10) || 'body of ' || event_type AS summary, "
    "ts AS created_at FROM events) "
)


def oracle_sql() -> dict[str, str]:
    two = '"a\u200bb\ufeff '
    steps = ", ".join(f"md5({f(SOCIAL)}) AS {n}" for n, f in NOISE.items())
    social_flags = measures(SOCIAL)
    return {
        "clean_invisible_and_fences": each(fences(f"({q(chr(171) + chr(187) + two)} || text)")),
        "clean_elongations": each(elongations("text")),
        "clean_lowercase": each("lower(text)"),
        "clean_punctuation": each(rr("text", P)),
        "clean_numbers": each(rr("text", r"\p{Nd}+")),
        "clean_stopwords": each(stopwords("text")),
        "clean_whitespace": each(squeeze("text")),
        "clean_blank_to_empty": each(
            rr(rr(rr("text", "[A-Za-z]"), P), rf"\A{WS}+\z")),
        "clean_unicode": each("nfc_normalize(text)"),
        "clean_token_phrases": each(phrases(chatty())),
        "clean_phrase_table": phrase_table(),
        "clean_noise_steps": f"SELECT doc_id, {steps} FROM documents",
        "clean_noise": each(noise(SOCIAL)),
        "clean_page_markup": each(NOISE["strip_urls"](NOISE["strip_tags"](
            "concat_ws(' ', url, html)")), table="pages", key="page_id"),
        "clean_configured": each(configured(f"nfc_normalize({SOCIAL})"), "processed_text"),
        "text_statistics": rounded_statistics(),
        "suggested_steps": f"SELECT {', '.join(f'({r}) AS {n}' for n, r in DECISIONS.items())} FROM ({statistics()})",
        "post_statistics_by_source": "SELECT source, " + ", ".join(
            f"count(*) FILTER ({e}) AS {n}" for n, e in sorted(social_flags.items()))
        + " FROM documents GROUP BY source",
        "scan_documents": "WITH " + scan_cte("documents", "doc_id", TERMS) + (
            "SELECT src.k AS doc_id, n IS NOT NULL AS has_profanity, coalesce(n, 0) AS profanity_count, "
            "coalesce(m, '') AS profanity_matches FROM src LEFT JOIN hits USING (k)"),
        "scan_disguised": "WITH " + scan_cte("documents", "doc_id", TERMS, DISGUISED) + (
            "SELECT src.k AS doc_id, coalesce(n, 0) AS profanity_count, "
            "coalesce(m, '') AS profanity_matches FROM src LEFT JOIN hits USING (k)"),
        "undisguised_text": each(undisguise(DISGUISED)),
        "scan_conversations_by_role": "WITH " + scan_cte(
            "(SELECT row_number() OVER () AS i, * FROM conversations)", "i", ["the", "de", "der"], more=", role") + (
            "SELECT role, count(n) AS flagged, count(*) AS total, count(n) / count(*) * 100 AS percent "
            "FROM src LEFT JOIN hits USING (k) GROUP BY role"),
        "flagged_share_by_language": "WITH " + scan_cte(
            "documents", "doc_id", TERMS, squeeze(rr(rr(fences("text"), P), r"\p{Nd}+")), ", lang") + (
            "SELECT lang, count(n) AS flagged, count(*) AS total, round(count(n) / count(*) * 100, 6) AS percent "
            "FROM src LEFT JOIN hits USING (k) GROUP BY lang"),
        "scan_large_lexicon": scan_large(),
        "sanitize_large_lexicon": sanitize_large(),
        "mask_profanity": sanitize_sql({}),
        "replace_profanity": sanitize_sql(PHRASES),
        "changed_row_count": sanitize_sql({}).replace(DISGUISED.replace("'", "'"), "text").split(
            " SELECT doc_id, o AS clean_text")[0]
        + f" SELECT count(*) FILTER (len(f) > 0) AS changed, count(*) AS total FROM s{len(TERMS)}",
        "augment_tokenize_join": each(joined(toks("text"))),
        "augment_synonyms": synonym_sql(),
        "augment_insertion": insertion_sql(),
        "augment_swap": swap_sql(),
        "augment_paraphrase": swap_sql("0.05", "paraphrase.swap", "(" + synonym_sql(
            "paraphrase.synonym", "0.15", out="text") + ")", "augmented_text"),
        "augment_insertion_table": insertion_sql("augmented_text"),
        "augment_paraphrase_table": swap_sql("0.05", "paraphrase.swap", "(" + synonym_sql(
            "paraphrase.synonym", "0.15", out="text") + ")", "augmented_text"),
        "augment_configured": configured_chain(),
        "row_ids_after_join": "SELECT count(*) AS n, 1 AS lo, count(*) AS hi, count(*) AS ids, "
                              "count(DISTINCT doc_id) AS docs FROM documents JOIN labels USING (doc_id)",
        "split_with_missing_labels": MISSING_LABELS,
        "augment_deletion": DELETION,
        "augment_back_translation": BACK,
        "augment_sentence_shuffle": SHUFFLE,
        "augment_sentence_crop": CROP,
        "augment_noise": NOISE_INJECTION,
        "augment_synonym_table": SYNONYM_TABLE,
        "column_profile": profile_sql("documents", [("doc_id", False), ("text", True), ("lang", True),
                                                    ("source", True), ("n_chars", False)], "text"),
        "column_profile_orders": profile_sql("orders", [
            ("o_orderkey", False), ("o_custkey", False), ("o_orderstatus", True), ("o_totalprice", False),
            ("o_orderdate", False), ("o_orderpriority", True)], "o_orderpriority"),
        "training_pair_verdicts": PAIRS,
        "blank_row_counts": f"SELECT count(*) AS rows, count(*) FILTER (doc_id % 9 < 2 OR {strip('text')} = '') AS skipped FROM documents",
        "truncated_texts": f"SELECT doc_id, substr({strip('text')}, 1, 12000) AS text_cut, length({strip('text')}) > 12000 AS was_cut FROM documents",
        "text_previews": "SELECT doc_id, substr(translate(text, chr(10) || chr(9), '  '), 1, 180) AS p180, "
                         "substr(replace(text, chr(10), ' '), 1, 500) AS p500 FROM documents",
        "preview_page": r"SELECT doc_id + 1 AS row_id, replace(replace(text, chr(10), '\n'), chr(9), ' ') AS text "
                        "FROM documents WHERE doc_id + 1 BETWEEN 151 AND 300",
        "page_counts": "SELECT count(*) AS rows, greatest(1, ceil(count(*) / 500))::BIGINT AS pages FROM documents",
        "edited_rows": "SELECT d.doc_id + 1 AS row_id, CASE WHEN l.doc_id IS NOT NULL THEN 'edited' WHEN d.doc_id < 100 THEN '' "
                       "ELSE text END AS text, lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 0",
        "sampled_rows": f"SELECT doc_id, lang FROM documents ORDER BY {draw('sample')} LIMIT 100",
        "sampled_rows_large": "WITH k AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k FROM lineitem) "
                              f"SELECT k FROM k ORDER BY {draw('sample', key='k')} LIMIT 12000",
        "label_counts": "SELECT toxic::VARCHAR AS label, count(*) AS rows FROM labels GROUP BY 1",
        "stratify_check": "SELECT count(*) AS classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS stratify "
                          "FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)",
        "scan_accuracy": JUDGED + "SELECT round(sum(hits) / sum(support), 4) AS accuracy, round(avg(f1), 4) AS f1_macro, "
                                  "round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM f",
        "scan_report": REPORT,
        "split_hashed": f"SELECT doc_id, {draw('split')} < '33333333' AS is_test FROM labels",
        "split_stratified": exact_split("labels", "doc_id", "toxic") + "SELECT doc_id, toxic, is_test FROM s",
        "split_sizes": "SELECT count(*) - ceil(count(*) * 0.2)::BIGINT AS samples_train, ceil(count(*) * 0.2)::BIGINT AS samples_test FROM lineitem",
        "tfidf_vocabulary": "WITH " + GRAMS.replace("{src}", "documents") + VOCAB.replace("{tf}", "tf"),
        "knn_predictions": KNN,
        "naive_bayes_predictions": BAYES + "SELECT * FROM best",
        "naive_bayes_metrics": BAYES + "SELECT count(*) FILTER (NOT is_test) AS samples_train, count(*) FILTER (is_test) AS samples_test, "
                               "round(avg((prediction_label = lab)::INT) FILTER (is_test), 4) AS accuracy FROM s JOIN best USING (doc_id)",
        "packed_batches": PACK,
        "batch_prompts": f"WITH {ITEMS} SELECT row_id::VARCHAR AS batch_id, md5('Rate:' || chr(10) || row_id || ': ' || txt) AS prompt FROM full_items",
        "score_rows": RESULTS + (
            f"SELECT row_id AS row_number, overall, {', '.join(SIX)}, CASE h WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Severe' END AS level, "
            "CASE WHEN h > 0 THEN 'Harassment' ELSE 'None' END AS category, CASE WHEN h > 0 THEN 'Insult' ELSE 'None' END AS toxicity_type, "
            f"{PREVIEW} AS text_preview FROM ok"),
        "score_rows_python": RESULTS + (
            f"SELECT row_id AS row_number, overall, {', '.join(SIX)}, CASE h WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Severe' END AS level, "
            "CASE WHEN h > 0 THEN 'Harassment' ELSE 'None' END AS category, CASE WHEN h > 0 THEN 'Insult' ELSE 'None' END AS toxicity_type, "
            f"{PREVIEW} AS text_preview FROM ok"),
        "csv_round_trip": "SELECT doc_id, text, lang FROM documents",
        "dispatched_file": "SELECT doc_id, text, lang FROM documents",
        "exported_row_results": "SELECT doc_id, text, concat_ws(', ', lang, source) AS tags FROM documents",
        "active_text": "SELECT doc_id, 'processed_text' AS active, md5(lower(text)) AS digest, 3::BIGINT AS n_columns FROM documents",
        "history_written": RUNS + (
            "SELECT run_type, count(*) AS n, sum(row_count)::BIGINT AS rows, count(DISTINCT id) AS ids, "
            "count(*) FILTER (user_id = 9) AS placed FROM runs WHERE user_id <> 8 GROUP BY run_type"),
        "json_round_trip": "SELECT doc_id, text, lang FROM documents",
        "text_lines": "SELECT comment_text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS comment_text "
                      "FROM documents) GROUP BY comment_text",
        "score_failures": RESULTS + "SELECT row_id, greatest(0, (SELECT count(*) FROM scored WHERE failed) - 20) AS n_more "
                                    "FROM scored WHERE failed ORDER BY row_id LIMIT 20",
        "score_summary": RESULTS + (
            "SELECT 'Completed' AS status, (SELECT count(*) FROM documents) AS rows_in_dataset, (SELECT count(*) FROM documents) AS rows, "
            f"count(*) AS analyzed, (SELECT count(*) FROM documents WHERE {strip('text')} = '') AS skipped, "
            "(SELECT count(*) FROM items WHERE txt = '') AS emptied, (SELECT count(*) FROM scored WHERE failed) AS errors, "
            "count(*) FILTER (overall >= 20) AS toxic, count(*) FILTER (overall < 20) AS non_toxic, round_even(avg(overall), 0)::INT AS avg_overall_score, "
            + ", ".join(f"round_even(avg({c}), 0)::INT AS avg_{c}" for c in SIX) + " FROM ok"),
        "run_record": RESULTS + (
            "SELECT 1::BIGINT AS user_id, 'dataset' AS run_type, 'documents' AS source_filename, count(*) AS row_count, "
            "count(*) FILTER (overall >= 20) AS toxic_count, count(*) FILTER (overall < 20) AS non_toxic_count FROM ok"),
        "dataset_report": report_sql(),
        "score_top_examples": RESULTS + f"SELECT row_id AS row_number, overall, {PREVIEW} AS text_preview FROM ok "
                                        "WHERE overall > 0 ORDER BY overall DESC, row_id LIMIT 5",
        "score_lines_and_bands": RESULTS + (
            f"SELECT row_id, {LINE} AS line, CASE WHEN overall < 35 THEN 'low' WHEN overall < 70 THEN 'medium' ELSE 'high' END AS band, "
            "overall >= 20 AS toxic_dataset, greatest(toxicity, insult) >= 20 AS toxic_single FROM ok"),
        "parsed_answers": PARSED,
        "answer_completeness": "SELECT doc_id, doc_id % 6 IN (0, 1, 3, 4) AS complete, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE 1 END AS n_complete FROM documents",
        "single_answers": SINGLE,
        "history_totals": RUNS + (
            "SELECT sum(row_count)::BIGINT AS comments_analyzed, sum(toxic_count)::BIGINT AS toxic_comments, sum(non_toxic_count)::BIGINT AS non_toxic_comments, "
            "round(sum(toxic_count) / (sum(toxic_count) + sum(non_toxic_count)) * 100, 1) AS toxic_percent, "
            "round(sum(non_toxic_count) / (sum(toxic_count) + sum(non_toxic_count)) * 100, 1) AS non_toxic_percent FROM runs"),
        "history_timeline": RUNS + "SELECT created_at::DATE AS day, sum(row_count)::BIGINT AS comments FROM runs GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
        "history_of_user": RUNS + "SELECT id, run_type, row_count FROM runs WHERE user_id = 8 ORDER BY id DESC LIMIT 5",
        "history_newest_per_user": RUNS + "SELECT user_id, id FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 3",
        "history_one_run": RUNS + "SELECT id, user_id, run_type FROM runs WHERE id IN (0, 1) AND user_id = 8",
        "history_without_user": RUNS + "SELECT run_type, count(*) AS n, sum(row_count)::BIGINT AS rows FROM runs WHERE user_id IS DISTINCT FROM 8 GROUP BY 1",
        "history_with_paths": RUNS + "SELECT id, CASE WHEN id % 10 = 3 THEN '/results/' || id END AS results_path FROM runs",
        "history_summaries": RUNS + (
            "SELECT id, CASE WHEN summary LIKE 'Overall:%' THEN string_split(summary, chr(10))[1] ELSE substr(string_split(summary, chr(10))[1], 1, 400) END AS head, "
            "CASE WHEN summary LIKE 'Overall:%' THEN string_split(summary, chr(10))[2] ELSE summary END AS body FROM runs"),
    }
