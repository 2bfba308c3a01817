"""SQL of the operators that SQL can express, for DuckDB over the same tables.

The tokenizers (op6, op13) and trained fields (op3, op7) are left out; tests hold these against
the tokenizers' libraries, exact round trips and held-out accuracy.
"""

from __future__ import annotations

from cloakframe.llm import bottomk, chat_format, mixing, sentence_spans

# -- XXH64 of strings, in numbers of 128 bits that are cut to 64 ----------------

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_WIDE = 1 << 64


def _u(x: int) -> str:
    return f"{x % _WIDE}::UHUGEINT"


def _mul(a: str, b: str) -> str:
    return f"(({a}) * ({b}) % {_WIDE}::UHUGEINT)"


def _add(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_WIDE}::UHUGEINT)"


def _rotated(x: str, r: int) -> str:
    return f"(({x}) * {1 << r}::UHUGEINT % {_WIDE}::UHUGEINT + ({x}) // {1 << 64 - r}::UHUGEINT)"


def _round(acc: str, x: str) -> str:
    return _mul(_rotated(_add(acc, _mul(x, _u(_P2))), 31), _u(_P1))


def _word(size: int, at: str) -> str:
    """The little-endian number of ``size`` bytes at a place of the hex string h."""
    return "CAST(concat('0x', " + ", ".join(f"substr(h, CAST(2 * ({at}) + {2 * k + 1} AS BIGINT), 2)" for k in range(size - 1, -1, -1)) + ") AS UBIGINT)::UHUGEINT"


def _xxh64(source: str, seed: int = 42) -> str:
    """Table expressions from ``source`` (s) to xxh_out (s, hash), hash unsigned."""

    def lane(k: int, start: int) -> str:
        return f"list_reduce(list_concat([{_u(start)}], list_transform(range(0, n // 32), lambda k: {_word(8, f'k * 32 + {8 * k}')})), lambda a, x: {_round('a', 'x')})"

    lanes = ", ".join(f"{lane(k, v)} AS v{k}" for k, v in enumerate((seed + _P1 + _P2, seed + _P2, seed, seed - _P1)))
    together = _add(_add(_add(_rotated("v0", 1), _rotated("v1", 7)), _rotated("v2", 12)), _rotated("v3", 18))
    merged = _add(_mul(f"xor(a, {_round('0::UHUGEINT', 'x')})", _u(_P1)), _u(_P4))
    eight = _add(_mul(_rotated(f"xor(a, {_round('0::UHUGEINT', 'x')})", 27), _u(_P1)), _u(_P4))
    four = _add(_mul(_rotated(f"xor(c, {_mul(_word(4, 'n // 8 * 8'), _u(_P1))})", 23), _u(_P2)), _u(_P3))
    one = _mul(_rotated(f"xor(a, {_mul('x', _u(_P5))})", 11), _u(_P1))
    last = lambda shift, times: _mul(f"xor(z, z // {1 << shift}::UHUGEINT)", _u(times))
    return f"""xxh_a AS (SELECT s, hex(encode(s)) AS h, strlen(s) AS n FROM {source}),
xxh_b AS (SELECT *, {lanes} FROM xxh_a),
xxh_c AS (SELECT *, CASE WHEN n >= 32 THEN list_reduce([{together}, v0, v1, v2, v3], lambda a, x: {merged}) ELSE {_u(seed + _P5)} END AS b FROM xxh_b),
xxh_d AS (SELECT *, list_reduce(list_concat([{_add('b', 'n::UHUGEINT')}], list_transform(range(n // 32 * 32, n // 8 * 8, 8), lambda k: {_word(8, 'k')})), lambda a, x: {eight}) AS c FROM xxh_c),
xxh_e AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {four} ELSE c END AS d FROM xxh_d),
xxh_f AS (SELECT s, list_reduce(list_concat([d], list_transform(range(n // 4 * 4, n), lambda k: {_word(1, 'k')})), lambda a, x: {one}) AS z FROM xxh_e),
xxh_g AS (SELECT s, {last(33, _P2)} AS z FROM xxh_f),
xxh_h AS (SELECT s, {last(29, _P3)} AS z FROM xxh_g),
xxh_out AS (SELECT s, CAST(xor(z, z // {1 << 32}::UHUGEINT) AS UBIGINT) AS hash FROM xxh_h)"""


def _split(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\t-\\r ]+'), lambda x: x <> '')"


def _shingles(words: str, width: int) -> str:
    joined = f"list_transform(range(1, len({words}) - {width - 2}), lambda i: array_to_string({words}[i:i + {width - 1}], ' '))"
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) <= {width} THEN [array_to_string({words}, ' ')] ELSE {joined} END"


# -- op2: bits by majority, all pairs, components by recursion -------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_split(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
e AS (SELECT doc_id, unnest({_shingles('w', 3)}) AS s FROM w),
t AS (SELECT DISTINCT s FROM e),
{_xxh64('t')},
b AS (SELECT doc_id, count(*) AS n, {', '.join(f'sum((hash >> {k}) & 1) AS b{k}' for k in range(64))} FROM e JOIN xxh_out USING (s) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(coalesce({' + '.join(f'CASE WHEN 2 * b{k} > n THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END' for k in range(64))}, 0::UHUGEINT) AS UBIGINT) AS fp FROM w LEFT JOIN b USING (doc_id)),
q AS (SELECT fp, min(doc_id) AS d FROM f GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM q a JOIN q b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
r(n, c) AS (SELECT fp, d FROM q UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT f.doc_id, lpad(lower(to_hex(f.fp)), 16, '0') AS fingerprint, m.c AS component_id FROM f JOIN m ON m.n = f.fp"""

# -- op4: bottom hashes as sorted lists -------------------------------------------

_K, _TOP = bottomk.K, 1 << bottomk.BITS


def _bottom(hashes: str) -> str:
    return f"list_sort(list_distinct({hashes}))[1:{_K}]"


def _count(sketch: str) -> str:
    return f"CASE WHEN len({sketch}) < {_K} THEN len({sketch})::DOUBLE ELSE {float((_K - 1) * _TOP)!r}::DOUBLE / ({sketch}[len({sketch})] + 1) END"


def _near(a: str, b: str) -> str:
    union = _bottom(f"list_concat({a}, {b})")
    return f"CASE WHEN len({union}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect({a}, {b}), {union}))::DOUBLE / len({union}) END"


def _text_form(sketch: str) -> str:
    return f"coalesce(base64(unhex(array_to_string(list_transform({sketch}, lambda x: lpad(to_hex(x), {bottomk.BITS // 4}, '0')), ''))), '')"


_OP4 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER w, CASE WHEN lead(doc_id) OVER w IS NULL THEN first_value(text) OVER w END, '') AS nxt FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT doc_id, text, nxt, length(text) AS n, concat(substr(text, 1, length(text) - length(text) // 3), substr(nxt, 1, length(text) // 3)) AS edited FROM d),
a AS (SELECT DISTINCT text AS body FROM c UNION SELECT nxt FROM c UNION SELECT edited FROM c),
w AS (SELECT body, {_split('body')} AS w FROM a),
e AS (SELECT DISTINCT body, unnest({_shingles('w', bottomk.WIDTH)}) AS s FROM w),
t AS (SELECT DISTINCT s FROM e),
{_xxh64('t')},
k AS (SELECT body, {_bottom(f'list(CAST(hash >> {64 - bottomk.BITS} AS BIGINT))')} AS sk FROM e JOIN xxh_out USING (s) GROUP BY body),
j AS (SELECT c.*, coalesce(k.sk, []) AS x, coalesce(y.sk, []) AS y, coalesce(z.sk, []) AS z FROM c LEFT JOIN k ON k.body = c.text LEFT JOIN k y ON y.body = c.edited LEFT JOIN k z ON z.body = c.nxt)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_text_form('x')} AS fingerprint, {_text_form('y')} AS edited_fingerprint, {_near('x', 'y')} AS near_edited, {_near('x', 'z')} AS near_next, {_count('x')} AS distinct_shingles,
  CASE WHEN len(y) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, ({_near('y', 'x')}) * ({_count(_bottom('list_concat(y, x)'))}) / ({_count('y')})) END AS edited_contained FROM j"""

# -- op1: pieces, their spans, and what is left --------------------------------

_MARK = "\ue000"
_OP1 = f"""WITH t AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?,;:][^A-Za-z0-9\\t-\\r \\x{{80}}-\\x{{10FFFF}}]*)([\\t-\\r ])', '\\1{_MARK}\\2', 'g'), '(\\n+)', '\\1{_MARK}', 'g'), '{_MARK}') AS raw FROM documents),
u AS (SELECT doc_id, k, raw[k] AS r, coalesce(list_sum(list_transform(raw[1:k-1], lambda x: length(x))), 0) AS pos FROM (SELECT doc_id, raw, unnest(range(1, len(raw) + 1)) AS k FROM t) q),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, CAST(pos + length(r) - length(regexp_replace(r, '^[\\t-\\r ]+', '')) AS BIGINT) AS start,
    list_filter(string_split_regex(r, '[\\t-\\r ]+'), lambda x: x <> '') AS w FROM u WHERE regexp_replace(r, '[\\t-\\r ]+', '', 'g') <> ''),
c AS (SELECT *, array_to_string(w, ' ') AS body, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS n, sum(len(w)) OVER (PARTITION BY doc_id) AS total FROM p),
l AS (SELECT doc_id, any_value(n) AS n, list(body ORDER BY i) AS bodies, list(upto ORDER BY i) AS sums FROM c GROUP BY doc_id),
s AS (SELECT c.doc_id, c.i, least(c.n, greatest(c.i + {sentence_spans.SPAN - 1}, len(list_filter(sums, lambda x: x < c.upto - len(c.w) + {sentence_spans.WORDS})) + 1)) AS k
  FROM c JOIN l USING (doc_id) WHERE c.i = 1 OR (c.n - c.i + 1 >= {sentence_spans.SPAN} AND c.total - c.upto + len(c.w) >= {sentence_spans.WORDS})),
z AS (SELECT doc_id, i, k FROM s UNION SELECT s.doc_id, s.i, l.n FROM s JOIN l USING (doc_id) WHERE s.i = (SELECT max(x.i) FROM s x WHERE x.doc_id = s.doc_id)),
h AS (SELECT z.*, array_to_string(bodies[i:k], chr(10)) AS body, k = n AND i > 1 AS tail FROM z JOIN l USING (doc_id)),
f AS (SELECT body, min(doc_id) AS d FROM h GROUP BY body),
g AS (SELECT doc_id, i, k FROM (SELECT h.*, f.d, row_number() OVER (PARTITION BY h.doc_id, h.body ORDER BY h.i, h.k) AS r FROM h JOIN f USING (body)) q WHERE d < doc_id OR r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, k + 1)) AS i FROM g),
m AS (SELECT c.doc_id, c.i, c.start, c.n, lead(c.start) OVER (PARTITION BY c.doc_id ORDER BY c.i) AS nxt, x.i IS NOT NULL AS off, lag(x.i IS NOT NULL, 1, false) OVER (PARTITION BY c.doc_id ORDER BY c.i) AS was FROM c LEFT JOIN gone x ON x.doc_id = c.doc_id AND x.i = c.i),
a AS (SELECT m.doc_id, max(n) AS n, count(*) FILTER (WHERE off) AS n_removed, count(*) FILTER (WHERE off AND NOT was) AS n_spans, bool_or(off AND i = n) AS ends,
    min(start) AS head, string_agg(substr(t.text, start + 1, coalesce(nxt, length(t.text)) - start), '' ORDER BY i) FILTER (WHERE NOT off) AS kept FROM m JOIN t USING (doc_id) GROUP BY m.doc_id),
o AS (SELECT t.doc_id, CASE WHEN coalesce(a.n_removed, 0) = 0 THEN t.text WHEN ends THEN regexp_replace(concat(substr(t.text, 1, head), kept), '[\\t-\\r ]+$', '') ELSE concat(substr(t.text, 1, head), kept) END AS text, coalesce(a.n, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans FROM t LEFT JOIN a USING (doc_id))
SELECT doc_id, text, n_sentences, n_removed, n_spans, sha256(coalesce(text, '')) AS kept_sha256 FROM o"""

# -- op5: windows of 50 bytes, cut from pieces of a thousand -------------------

_OP5 = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, pos, substr(h, 2 * pos + 1, 2 * 1049) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 1000)) AS pos FROM t WHERE n >= 50) q),
w AS (SELECT doc_id, pos + j AS i, substr(part, CAST(2 * j + 1 AS BIGINT), 100) AS g FROM (SELECT doc_id, pos, part, unnest(range(0, least(1000, n - 49 - pos))) AS j FROM c) q),
f AS (SELECT g, min(doc_id) AS d FROM w GROUP BY g),
s AS (SELECT w.doc_id, w.i FROM w JOIN f USING (g) WHERE f.d < w.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s) q),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM r),
o AS (SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, concat(string_agg(substr(t.h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a), substr(any_value(t.h), CAST(2 * max(b) + 1 AS BIGINT))) AS kept FROM e JOIN t USING (doc_id) GROUP BY e.doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(o.n_removed, 0) AS BIGINT) AS n_removed, coalesce(o.n_spans, 0) AS n_spans, sha256(unhex(coalesce(o.kept, t.h))) AS kept_sha256 FROM t LEFT JOIN o USING (doc_id)"""

# -- op8: turns, loss and length of the output ----------------------------------


def _op8(t: chat_format.Template = chat_format.DEFAULT) -> str:
    marks = [*t.controls(), t.escape]
    escaped = lambda x: f"length({x}) + " + " + ".join(f"(length({x}) - length(replace({x}, '{m}', ''))) // {len(m)}" for m in marks)
    listed = ", ".join(f"'{r}'" for r in t.roles)
    around = " ".join(f"WHEN '{n}' THEN {len(r.before) + len(r.after)}" for n, r in t.roles.items())
    other = len(t.other.before) - 1 + len(t.other.after)
    loss = ", ".join(f"'{n}'" for n, r in t.roles.items() if r.loss)
    moves = " OR ".join(f"(was = '{a}' AND role IN ({', '.join(repr(x) for x in sorted(b))}))" for a, b in t.moves.items())
    said = "</s>[INST] ok [/INST]"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}') x),
o AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS was, lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS next FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
  CAST({len(t.begin) + len(t.end)} + sum({escaped('text')} + CASE role {around} ELSE {other} + {escaped('role')} END) AS BIGINT) AS formatted_chars,
  bool_and(({moves}) AND (next IS NOT NULL OR role IN ({', '.join(repr(x) for x in sorted(t.final))}))) AS valid
FROM o GROUP BY conv_id"""


# -- op9: targets by the highest level, prefix sums by key ----------------------

_OP9 = f"""WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN {mixing.LABEL_QUALITY[1]} WHEN 0 THEN {mixing.LABEL_QUALITY[0]} ELSE 1 END::DOUBLE) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '')) AS BIGINT) AS size,
    -ln((CAST(concat('0x', substr(md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), concat('text:', md5(coalesce(text, '')))))), 1, 13)) AS BIGINT)::DOUBLE + 1) / {float(1 << 52)!r}::DOUBLE) / coalesce(q.q, 1.0::DOUBLE) AS key FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM d GROUP BY source),
l AS (SELECT *, {mixing.CAP}::DOUBLE * source_size AS full_at, sum(source_size) OVER () AS n, sum(w) OVER () AS ws, coalesce(sum({mixing.CAP}::DOUBLE * source_size) OVER b, 0) AS given, coalesce(sum(w) OVER b, 0) AS weighed
  FROM s WINDOW b AS (ORDER BY {mixing.CAP}::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(full_at, w * max((n - given) / (ws - weighed)) OVER ()) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(least(target / source_size, {mixing.CAP}::DOUBLE)) AS BIGINT) ELSE 0 END AS whole FROM g),
b AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM e),
k AS (SELECT source, source_size, target, whole + CASE WHEN source_size > 0 AND rest >= source_size THEN 1 ELSE 0 END AS epochs, CASE WHEN source_size > 0 AND rest >= source_size OR whole >= {mixing.CAP} THEN 0 ELSE rest END AS budget FROM b)
SELECT d.doc_id, d.size, d.source, k.source_size, k.target, CAST(k.epochs * d.size + greatest(0, least(d.size, k.budget - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source"""

# -- op10: all pairs, and components by recursion -------------------------------

_OP10 = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON m.n = v.vec_id LEFT JOIN k ON k.a = v.vec_id"""

# -- op11: stretches of equal triples at each distance ---------------------------

_OP11 = """WITH c AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '') AS w,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS BIGINT), 1))::UBIGINT)), lambda r, b: list_reduce(list_concat([xor(r, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS r FROM documents),
h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, CAST(xor(r, 4294967295::UBIGINT) AS BIGINT) AS h FROM c),
p AS (SELECT *, (h // 10) % greatest(n, 1) AS a, h % 10 = 0 AND n > 0 AS planted FROM h),
e AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS s FROM e),
t AS (SELECT doc_id, n, i, concat(s, ' ', lead(s, 1) OVER o, ' ', lead(s, 2) OVER o) AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(s, 2) OVER o IS NOT NULL),
m AS (SELECT doc_id, n, i, g FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 3),
j AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
k AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM j),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM k GROUP BY doc_id, q, island),
u AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM u GROUP BY doc_id),
f AS (SELECT doc_id, start, length, period FROM u a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period::DOUBLE DESC, start, period) = 1),
o AS (SELECT x.doc_id, string_agg(x.s, ' ' ORDER BY x.i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = x.doc_id AND x.i >= u.start + u.period AND x.i < u.start + u.length) GROUP BY x.doc_id)
SELECT e.doc_id, coalesce(b.n_runs, 0) AS n_runs, f.start, f.length, f.period, 1000 * f.length // f.period AS exponent_milli, sha256(coalesce(b.listed, '')) AS runs_sha256, sha256(coalesce(o.kept, '')) AS collapsed_sha256
FROM e LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN o USING (doc_id)"""

# -- op12: two rounds over all parts, then codes ---------------------------------


def _op12(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def assigned(book: str) -> str:
        # far and entry in one number: the least of it is the nearest entry, the lower of equals
        return f"SELECT p.vec_id, p.label, p.pos, p.x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - b.x[k]) * (p.x[k] - b.x[k])))::HUGEINT * {entries} + b.entry) AS near FROM p JOIN {book} b USING (pos) GROUP BY ALL"

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS ({assigned(f'b{r}')})")
        steps.append(f"s{r} AS (SELECT pos, near % {entries} AS entry, k, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT pos, near, unnest(x) AS v, unnest(range(len(x))) AS k FROM a{r}) q GROUP BY ALL)")
        steps.append(f"b{r + 1} AS (SELECT b.pos, b.entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT pos, entry, list(m ORDER BY k) AS x FROM s{r} GROUP BY ALL) n ON n.pos = b.pos AND n.entry = b.entry)")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({256} * x::DOUBLE) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, pos, list_slice(e, pos * (len(e) // {parts}) + 1, (pos + 1) * (len(e) // {parts})) AS x FROM v, (SELECT unnest(range({parts})) AS pos) q),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries}),
{", ".join(steps)},
z AS ({assigned(f'b{rounds}')}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(near % {entries} AS INTEGER)), '' ORDER BY pos) AS code, CAST(sum(near // {entries}) AS BIGINT) AS error FROM z GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


ORACLES: dict[str, str] = {"op1_substring_dedup": _OP1, "op2_simhash_near_dedup": _OP2, "op4_document_fingerprints": _OP4, "op5_suffix_array_dedup": _OP5, "op8_chat_formatting": _op8(), "op9_source_mixing": _OP9, "op10_embedding_near_dedup": _OP10, "op11_periodic_runs": _OP11, "op12_vector_codes": _op12()}
