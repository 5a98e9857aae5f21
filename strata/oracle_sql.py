"""SQL text helpers for the DuckDB oracle queries in ``__spark_entry__.oracle_sql``.

These only build SQL strings for the independent cross-check; no Spark code uses them.
"""

from __future__ import annotations

_M32 = "4294967296"

# MurmurHash3_x86_32 constants (c1, c2, the h1 mixing constants, the two
# finalisation multipliers) and the seed used by the hashing term-frequency transform.
MM3_C1 = 0xCC9E2D51
MM3_C2 = 0x1B873593
MM3_H_MUL = 5
MM3_H_ADD = 0xE6546B64
MM3_F1 = 0x85EBCA6B
MM3_F2 = 0xC2B2AE35
MM3_SEED = 42

TRIM_RE = r"^[\x00-\x20]+|[\x00-\x20]+$"


def round_stable(x: str, places: int = 6) -> str:
    return f"(round(({x}) + 1.234567e-7, {places}) + 0.0)"


def tokens(text: str = "text") -> str:
    """list of tokens: same definition as strata.functions.text.tokens."""
    return (f"list_filter(regexp_split_to_array(regexp_replace({text}, '{TRIM_RE}', '', 'g'), '\\s+'), "
            f"lambda w: w <> '')")


def _mul(a: str, c: int) -> str:
    return f"(((({a})::HUGEINT * {c}) % {_M32})::BIGINT)"


def _rotl(x: str, r: int) -> str:
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & 4294967295)"


def _mix(h: str, k: str) -> str:
    k1 = _mul(_rotl(_mul(k, MM3_C1), 15), MM3_C2)
    h1 = _rotl(f"xor({h}, {k1})", 13)
    return f"((({h1}) * {MM3_H_MUL} + {MM3_H_ADD}) % {_M32})"


def murmur3_ctes(src: str, term: str = "term", standard: bool = False) -> tuple[str, str]:
    """CTEs that add column ``h`` (signed 32-bit MurmurHash3 of ``term``) to relation ``src``: the legacy
    form, which mixes each byte after the last whole block on its own, or the ``standard`` one.

    Returns (cte_text, name_of_final_relation)."""
    b = (f"[(('0x' || substr(hex(encode({term})), 2*i+1, 2))::BIGINT) "
         f"for i in range(octet_length(encode({term})))]")
    blocks = "[bs[4*i+1] + bs[4*i+2]*256 + bs[4*i+3]*65536 + bs[4*i+4]*16777216 for i in range(len(bs) // 4)]"
    tail = "[CASE WHEN x >= 128 THEN x + 4294967040 ELSE x END for x in bs[(len(bs) // 4) * 4 + 1:]]"
    lam = _mix("acc", "k")
    last = "0::BIGINT"
    if standard:
        short = "list_sum([bs[(len(bs) // 4) * 4 + 1 + i] * [1, 256, 65536][i + 1] for i in range(len(bs) % 4)])"
        last = _mul(_rotl(_mul(f"coalesce({short}, 0)::BIGINT", MM3_C1), 15), MM3_C2)
        tail = "[]::BIGINT[]"
    ctes = f"""
mm_b AS (SELECT *, {b} AS bs FROM {src}),
mm_k AS (SELECT *, len(bs) AS mm_n, list_concat({blocks}, {tail}) AS ks FROM mm_b),
mm_h0 AS (SELECT *, list_reduce(ks, lambda acc, k: {lam}, {MM3_SEED}::BIGINT) AS h0 FROM mm_k),
mm_f1 AS (SELECT *, xor(xor(h0, {last}), mm_n::BIGINT) AS f1 FROM mm_h0),
mm_f2 AS (SELECT *, xor(f1, f1 >> 16) AS f2 FROM mm_f1),
mm_f3 AS (SELECT *, {_mul('f2', MM3_F1)} AS f3 FROM mm_f2),
mm_f4 AS (SELECT *, xor(f3, f3 >> 13) AS f4 FROM mm_f3),
mm_f5 AS (SELECT *, {_mul('f4', MM3_F2)} AS f5 FROM mm_f4),
mm_f6 AS (SELECT *, xor(f5, f5 >> 16) AS f6 FROM mm_f5),
mm_out AS (SELECT * EXCLUDE (bs, mm_n, ks, h0, f1, f2, f3, f4, f5, f6),
           CASE WHEN f6 >= 2147483648 THEN f6 - {_M32} ELSE f6 END AS h FROM mm_f6)"""
    return ctes, "mm_out"


def native_hash(term: str = "term") -> str:
    """Signed JVM String.hashCode (BMP text: one code unit per character)."""
    u = (f"list_reduce(list_transform(string_split({term}, ''), lambda c: unicode(c)::BIGINT), "
         f"lambda a, x: (a * 31 + x) % {_M32}, 0::BIGINT)")
    return f"(CASE WHEN {u} >= 2147483648 THEN {u} - {_M32} ELSE {u} END)"


def pmod(x: str, n: int) -> str:
    return f"((({x}) % {n} + {n}) % {n})"


# ----------------------------------------------------------------------------- k-means
#
# Relations: points (id, f), centers (cid, c), candidates with a weight (cid, c, w).  Each function
# returns the CTEs it adds, all materialised, and the name of the last one.

def uniform(seed: int, *cols: str) -> str:
    """The draw of strata.functions.hashing.uniform."""
    text = "concat_ws(':', " + ", ".join([f"'{int(seed)}'", *[f"({c})::VARCHAR" for c in cols]]) + ")"
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / {1 << 52})"


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _distinct(rel: str) -> str:
    """Distinct vectors of points as centers, in the order of their lowest id."""
    return f"SELECT row_number() OVER (ORDER BY id) - 1 AS cid, f AS c FROM (SELECT min(id) AS id, f FROM {rel} GROUP BY f)"


def random_centers(points: str, k: int, seed: int) -> tuple[list[str], str]:
    sample = f"(SELECT id, f FROM {points} ORDER BY {uniform(seed, 'id')}, id LIMIT {k})"
    return [f"rc AS MATERIALIZED ({_distinct(sample)})"], "rc"


def parallel_candidates(points: str, k: int, steps: int, seed: int) -> tuple[list[str], str]:
    ctes = [f"n0 AS MATERIALIZED (SELECT id, f FROM {points} ORDER BY {uniform(seed, 'id')}, id LIMIT 1)",
            f"w0 AS MATERIALIZED (SELECT p.id, p.f, {_dist('p.f', 'n0.f')} AS cost FROM {points} p, n0)"]
    for s in range(steps):
        ctes.append(f"n{s + 1} AS MATERIALIZED (SELECT id, f FROM w{s} WHERE {uniform(seed + 1 + s, 'id')} < {2.0 * k} * cost / (SELECT sum(cost) FROM w{s}))")
        ctes.append(f"w{s + 1} AS MATERIALIZED (SELECT w.id, any_value(w.f) AS f, least(any_value(w.cost), coalesce(min({_dist('w.f', 'n.f')}), 'inf'::DOUBLE)) AS cost "
                    f"FROM w{s} w LEFT JOIN n{s + 1} n ON true GROUP BY w.id)")
    every = " UNION ALL ".join(f"SELECT * FROM n{s}" for s in range(steps + 1))
    return [*ctes, f"cand AS MATERIALIZED ({_distinct(f'({every})')})"], "cand"


def reduced_centers(cands: str, k: int, seed: int, steps: int) -> tuple[list[str], str]:
    """Weighted k-means++ draws, each an exponential race, then weighted Lloyd steps (steps after the
    assignment has settled change nothing)."""
    ctes, mass = [], f"(SELECT cid, c, w, 1.0::DOUBLE AS near FROM {cands})"
    for j in range(k):
        ctes.append(f"d{j} AS MATERIALIZED (SELECT {j} AS cid, c FROM {mass} WHERE w * near > 0 ORDER BY -ln({uniform(seed, str(j), 'cid')}) / (w * near), cid LIMIT 1)")
        near = _dist("m.c", f"d{j}.c")
        ctes.append(f"m{j} AS MATERIALIZED (SELECT m.cid, m.c, m.w, {near if j == 0 else f'least(m.near, {near})'} AS near FROM {mass} m, d{j})")
        mass = f"m{j}"
    ctes.append("s0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM d{j}" for j in range(k)) + ")")
    for i in range(steps):
        best = f"(SELECT q.cid AS qid, any_value(q.c) AS c, any_value(q.w) AS w, arg_min(s.cid, struct_pack(d := {_dist('q.c', 's.c')}, i := s.cid)) AS cid FROM {cands} q, s{i} s GROUP BY q.cid)"
        mean = f"(SELECT cid, list(m ORDER BY pos) AS c FROM (SELECT cid, pos, sum(w * x) / sum(w) AS m FROM (SELECT cid, w, unnest(range(len(c))) AS pos, unnest(c) AS x FROM {best}) GROUP BY cid, pos HAVING sum(w) > 0) GROUP BY cid)"
        ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT s.cid, coalesce(n.c, s.c) AS c FROM s{i} s LEFT JOIN {mean} n USING (cid))")
    return ctes, f"s{steps}"


def parallel_centers(points: str, k: int, steps: int, seed: int, reduce_steps: int = 30) -> tuple[list[str], str]:
    ctes, cand = parallel_candidates(points, k, steps, seed)
    nearest = f"(SELECT p.id, arg_min(c.cid, struct_pack(d := {_dist('p.f', 'c.c')}, i := c.cid)) AS cid FROM {points} p, {cand} c GROUP BY p.id)"
    ctes.append(f"qw AS MATERIALIZED (SELECT c.cid, c.c, coalesce(n.w, 0)::DOUBLE AS w FROM {cand} c LEFT JOIN (SELECT cid, count(*) AS w FROM {nearest} GROUP BY cid) n USING (cid))")
    more, last = reduced_centers("qw", k, seed, reduce_steps)
    few = f"(SELECT count(*) FROM {cand}) <= {k}"
    return [*ctes, *more, f"pc AS MATERIALIZED (SELECT cid, c FROM {cand} WHERE {few} UNION ALL SELECT cid, c FROM {last} WHERE NOT ({few}))"], "pc"


def lloyd_until(points: str, start: str, steps: int, eps: float) -> tuple[list[str], str]:
    """Lloyd steps until no center moves more than ``eps``, ``steps`` at most."""
    ctes, now, before = [], start, None
    for i in range(steps):
        best = f"(SELECT p.id, any_value(p.f) AS f, arg_min(l.cid, struct_pack(d := {_dist('p.f', 'l.c')}, i := l.cid)) AS cid FROM {points} p, {now} l GROUP BY p.id)"
        mean = f"(SELECT cid, list(m ORDER BY pos) AS c FROM (SELECT cid, pos, avg(x) AS m FROM (SELECT cid, unnest(range(len(f))) AS pos, unnest(f) AS x FROM {best}) GROUP BY cid, pos) GROUP BY cid)"
        still = f"(SELECT max({_dist('a.c', 'b.c')}) FROM {now} a JOIN {before} b USING (cid)) <= {eps * eps!r}" if before else "false"
        ctes.append(f"l{i} AS MATERIALIZED (SELECT o.cid, CASE WHEN {still} THEN o.c ELSE coalesce(n.c, o.c) END AS c FROM {now} o LEFT JOIN {mean} n USING (cid))")
        now, before = f"l{i}", now
    return ctes, now
