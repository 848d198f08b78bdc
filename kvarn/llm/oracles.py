"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .license_scan import DILUTION, PHRASES, RUN, TEMPLATES, need

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _list(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def license_sql() -> str:
    """Base phrases by word positions; templates by the words that lines and runs of lines share with them, without filters."""
    places, labels = [], []
    for k, (phrase, label) in enumerate(PHRASES.items()):
        test = " and ".join(f"w[i+{j}]='{x}'" for j, x in enumerate(phrase.split()))
        places.append(f"list_filter(range(1,len(w)+1), lambda i: coalesce({test}, false)) as p{k}")
        labels.append(f"case when len(p{k})>0 then ['{label}'] else [] end")
    best, found, scores = [], [], []
    for k, (label, text) in enumerate(TEMPLATES):
        words = sorted(set(text.split()))
        fits = f"b.n=1 or len(b.w)<={DILUTION * len(words)}"
        best.append(f"coalesce(list_max(list_transform(list_filter(blocks, lambda b: {fits}), lambda b: len(list_intersect(b.w, {_list(words)})))),0) as m{k}")
        found.append(f"case when m{k}>={need(len(words))} then ['{label}'] else [] end")
        scores.append(f"case when m{k}>={need(len(words))} then m{k}/{len(words)}.0::double else 0.0::double end")
    every = lambda parts: "flatten([" + ",".join(parts) + "])"
    joined = lambda parts: f"coalesce(array_to_string(list_sort(list_distinct({every(parts)})), ','),'')"
    # blocks: lines, and runs of adjacent lines that all have a word
    runs = [
        f"list_transform(list_filter(range(1,len(l)-{n}+2), lambda i: len(list_filter(l[i:i+{n}-1], lambda x: len(x)=0))=0), lambda i: {{'n':{n}, 'w':list_distinct(flatten(l[i:i+{n}-1]))}})"
        for n in range(1, RUN + 1)
    ]
    return (
        f"with t as (select doc_id, translate(coalesce(text,''),'{UPPER}','{LOWER}') as x from documents), "
        f"s as (select doc_id, regexp_extract_all(x, '{_WORDS}') as w, list_transform(string_split(x, chr(10)), lambda y: regexp_extract_all(y, '{_WORDS}')) as l from t), "
        f"d as (select doc_id, w, {'||'.join(runs)} as blocks from s), "
        f"p as (select doc_id, w, {', '.join(places)}, {', '.join(best)} from d) "
        f"select doc_id, len(w) as n_words, len(p0)+len(p1)+len(p2) as n_base, list_min(p0||p1||p2)-1 as first_word, list_max(p0||p1||p2)-1 as last_word, "
        f"{joined(labels)} as base_labels, {joined(labels + found)} as labels, greatest({', '.join(scores)}, case when len(p0)+len(p1)+len(p2)>0 then 1.0::double else 0.0::double end) as score from p"
    )


def join_sql() -> str:
    """Shingles as text, pairs that share one, and what they reach: plain, and quadratic in how common a shingle is."""
    return (
        f"with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents), "
        "s as (select doc_id, case when len(w)=0 then [] when len(w)<3 then [array_to_string(w,' ')] else list_distinct(list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) end as g from d), "
        "u as (select doc_id, len(g) as n, unnest(g) as x from s), "
        "p as (select a.doc_id as i, b.doc_id as j, a.n as ni, b.n as nj, count(*) as c from u a join u b on a.x=b.x and a.doc_id<b.doc_id and 100*least(a.n,b.n)>=90*greatest(a.n,b.n) group by 1,2,3,4), "
        "e as (select i, j from p where 100*c>=90*(ni+nj-c)), b as (select i, j from e union all select j, i from e), "
        "r(doc_id, root) as (select doc_id, doc_id from documents union select b.j, r.root from r join b on b.i=r.doc_id) "
        "select s.doc_id, len(s.g) as n_shingles, m.component_id from s join (select doc_id, min(root) as component_id from r group by 1) m on m.doc_id=s.doc_id"
    ).replace("\\\\", "\\")


SQL = {"op2_ngram_join": join_sql(), "op4_license_scan": license_sql()}
