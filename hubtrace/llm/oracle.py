"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from hubtrace.llm.license_scan import CLAIM, COMMENT, HINT, LOWER, NAMED, OPEN_LINE, RULES, SENTENCES, SPDX_HEAD, UPPER


def _license_scan() -> str:
    kinds = "\n".join(f"when regexp_matches(s, '{p}') then '{n}'" for n, p in SENTENCES)
    steps, last = [], "marked"
    claims = [rule for rule in RULES if "reserved" in rule[1]]
    for k, (name, ids) in enumerate([rule for rule in RULES if rule not in claims] + claims):
        if claims and (name, ids) == claims[0]:
            steps.append(
                f"beside as (select doc_id, ids, regexp_replace(regexp_replace(rest, '{CLAIM}/', '/', 'g'), "
                f"'/{CLAIM}', '/', 'g') as rest, hits from {last})"
            )
            last = "beside"
        pattern = "".join(f"<{x}>" for x in ids)
        steps.append(
            f"r{k} as (select doc_id, ids, replace(rest, '{pattern}', '/') as rest, "
            f"case when contains(rest, '{pattern}') then list_append(hits, '{name}') else hits end as hits from {last})"
        )
        last = f"r{k}"
    return f"""
with cut as (
  select doc_id, case when regexp_matches(coalesce(text, ''), '{HINT}') then string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      text, '{SPDX_HEAD}', chr(10) || 'SPDX-License-Identifier ', 'g'), '{COMMENT}', '\\1', 'g'),
      '{OPEN_LINE}', '\\1 \\2', 'g'), '\\n([ \\t]*[a-z])', ' \\1', 'g'),
      '([.!?;:][#*$%&|<>]*)[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) else [] end as parts
  from documents),
plain as (
  select doc_id, list_transform(parts, lambda p: regexp_replace(trim(regexp_replace(
    translate(p, '{UPPER}', '{LOWER}'), '[^a-z0-9.+]+', ' ', 'g')), '[ .]+$', '')) as parts from cut),
named as (
  select doc_id, list_filter(list_transform(parts, lambda s: case when s = '' then null {kinds} end),
    lambda x: x is not null) as ids from plain),
marked as (
  select doc_id, ids, regexp_replace(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''),
    '<{NAMED}[^>]*>', '/', 'g') as rest,
    list_transform(list_filter(ids, lambda x: starts_with(x, '{NAMED}')), lambda x: substr(x, {len(NAMED) + 1})) as hits
  from named),
{', '.join(steps)}
select doc_id, len(ids)::bigint as n_sentences, array_to_string(ids, ',') as identifiers,
  array_to_string(list_filter(hits, lambda h, i: list_position(hits, h) = i), ',') as licences,
  (length(rest) - length(replace(rest, '<', '')))::bigint as n_left
from {last}
"""


LICENSE_SCAN = _license_scan()

#: The registered mix: weights of sources in turn, and schedules of as much area that are level, rise and fall.
WEIGHTS = (1, 2, 3)
SCHEDULES = ((1.0, 1.0), (1.0, 3.0), (4.0, 2.0))


def _mixing() -> str:
    choice = lambda values: "case rank % 3 " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"
    return f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank
  from sized group by source),
weighted as (
  select *, ({choice(WEIGHTS)})::double as weight, ({choice(s[0] for s in SCHEDULES)})::double as a,
    ({choice(s[1] for s in SCHEDULES)})::double as b from sources),
ahead as (
  select *, coalesce(sum(3 * source_size) over w, 0)::bigint as caps, coalesce(sum(weight) over w, 0) as weights
  from weighted window w as (
    order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
  select max(((select sum(source_size) from sources)::bigint - caps)::double
    / ((select sum(weight) from weighted) - weights)) as level from ahead),
aimed as (
  select *, case when (select sum(source_size) from sources) = 0 then 0.0
    else least((3 * source_size)::double, (select level from level) * weight) end as target from weighted),
placed as (
  select doc_id, size, source_size, target, a, b, round(target)::bigint as goal, coalesce(sum(size) over (
    partition by t.source order by md5('42:' || coalesce(doc_id::varchar, 'null') || ':' || size), doc_id nulls first
    rows between unbounded preceding and 1 preceding), 0)::bigint as place
  from sized t join aimed s on t.source is not distinct from s.source)
select doc_id, size, source_size, target,
  (greatest(least(size, goal - place), 0) + greatest(least(size, goal - source_size - place), 0)
    + greatest(least(size, goal - 2 * source_size - place), 0))::bigint as taken,
  case when least(size, goal - place) > 0 then least(2 * (place::double / target * ((a + b) / 2))
    / (a + sqrt(a * a + 2 * (b - a) * (place::double / target * ((a + b) / 2)))), 1.0) end as first_position
from placed
"""


MIXING = _mixing()
