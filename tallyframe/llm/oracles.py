"""DuckDB SQL of the operators whose statements are long: the Jaccard join, the secret scan, the quality rules and the source audit."""

from __future__ import annotations

from tallyframe.llm import divergence, rules, secrets

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def jaccard_sql(k: int, percent: int) -> str:
    """Equal sets are one node, pairs of nodes meet by their shingles, components are the closure of the links."""
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: {gram}))) end as s from w),
n as (select doc_id, len(s) as n, s, case when len(s) = 0 then doc_id else min(doc_id) over (partition by s) end as node from s),
g as (select node, n, unnest(s) as g from n where doc_id = node),
o as (select a.node as a, b.node as b, a.n as an, b.n as bn, count(*) as shared from g a join g b using (g) where a.node < b.node group by all),
l as (select a, b from o where 100 * shared >= {percent} * (an + bn - shared)), e as (select a, b from l union all select b, a from l),
c as (select node as a, node as b from n union select c.a, e.b from c join e on c.b = e.a), f as (select a as node, min(b) as component_id from c group by 1)
select doc_id, n as n_shingles, component_id from n join f using (node)"""


def _windows(n: int) -> str:
    """Words in n-word windows that occur again, and characters of words in windows that occurred before."""
    return f"""g{n} as (select doc_id, p, size, max(again) over w > 0 as held, max(later) over w > 0 as later from (select *, (g is not null and count(*) over (partition by doc_id, g) > 1)::int as again,
(g is not null and row_number() over (partition by doc_id, g order by p) > 1)::int as later from (select doc_id, p, length(w[p]) as size, case when p + {n - 1} <= len(w) then array_to_string(w[p : p + {n - 1}], ' ') end as g from x))
window w as (partition by doc_id order by p rows between {n - 1} preceding and current row)),
c{n} as (select doc_id, count(*) filter (held) as words, coalesce(sum(size) filter (later), 0) as chars from g{n} group by 1)"""


def rules_sql(limits: dict[int, float] = rules.LIMITS) -> str:
    lengths = [n for n in limits if n]
    within = " and ".join(f"coalesce({f'c{n}' if n else 'd'}.chars, 0) <= {most}::double * length(array_to_string(w, ''))" for n, most in limits.items())
    return f"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents), x as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from t),
{", ".join(_windows(n) for n in (3, *lengths))},
i as (select doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) as chars from (select doc_id, unnest(string_split(text, chr(10))) as line from t)),
d as (select doc_id, sum(n - 1) as lines, sum((n - 1) * chars) as chars from (select doc_id, line, chars, count(*) as n from i where chars > 0 group by all) group by 1),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(d.lines, 0)::bigint as n_dup_lines,
coalesce(c3.words, 0) as n_repeat_words, {within} as within from t left join d using (doc_id) left join c3 using (doc_id) {" ".join(f"left join c{n} using (doc_id)" for n in lengths)}),
b as (select *, n_words < {rules.LEAST_WORDS} or 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and within as kept from b"""


def secrets_sql(kinds: tuple = secrets.BASE_RULES + secrets.MORE_RULES) -> str:
    """A match starts after the pieces and matches before it, which splitting by the regex gives."""
    parts = []
    for rank, (kind, regex, group, least) in enumerate(kinds):
        regex = regex.replace("'", "''")
        before = "list_sum(list_transform(p[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0)"
        # Runs of hexadecimal digits are in every text; only texts with one that is long enough are split.
        able = f"[0-9a-f]{{{least}}}" if kind == "hex" else regex
        parts.append(f"""select doc_id, {rank} as rank, '{kind}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: [{before}, length(m[i])])) as span,
unnest(list_transform(m, lambda y: length(regexp_extract(y, '{regex}', {group})) >= {least})) as passes
from (select doc_id, regexp_extract_all(text, '{regex}') as m, string_split_regex(text, '{regex}') as p from t where regexp_matches(text, '{able}'))""")
    joined = lambda which: f"coalesce(string_agg(kind || ':' || span[1]::bigint || ':' || (span[1] + span[2])::bigint, ',' order by span[1], rank) filter ({which}), '')"
    base = [kind for kind, *_ in secrets.BASE_RULES]
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents), s as ({" union all ".join(parts)}), f as (select * from s where passes)
select t.doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in base)}, sha256({joined(f"rank < {len(base)}")}) as base_sha256, {joined("true")} as spans
from t left join f using (doc_id) group by t.doc_id"""


def divergence_sql(least_docs: int = 10, ranks: int = 10) -> str:
    share = f"1 + ({divergence.UNIT}::hugeint * ({{c}} + {divergence.SMOOTH})) // ({{n}} + {divergence.SMOOTH} * v)"
    differ = "((({p} - {q}) * ({p} - {q})) // ({p} + {q}))"
    return f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
t as (select lang, source, term, count(*) as n, count(distinct r) as docs from w group by all), k as (select lang, term from t group by all having sum(docs) >= {least_docs}),
v as (select lang, count(*) as v from k group by 1), g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, v.v, coalesce(t.n, 0) as c from g join k using (lang) join v using (lang) left join t using (lang, source, term)),
p as (select lang, source, term, c, {share.format(c="c", n="sum(c) over (partition by lang, source)")} as p from c),
q as (select lang, term, {share.format(c="c", n="sum(c) over (partition by lang)")} as q from (select lang, term, v, sum(c) as c from c group by all)),
x as (select a.lang, a.source, b.source as item, sum{differ.format(p="a.p", q="b.p")} as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
union all select lang, source, 'term', term, {differ.format(p="p", q="q")} from p join q using (lang, term) where c > 0 and p > q),
r as (select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from o)
select * from r where part = 'pair' or rank <= {ranks}"""
