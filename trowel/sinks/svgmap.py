"""The interactive map: folders as boxes, modules as cards, ribbons between folders, and what a click shows.

A page's tables are collected once; their rows are bounded by the listing's max_files and by the limits below.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trowel.functions import text as T
from trowel.operators import geometry as G
from trowel.operators import summaries
from trowel.plans.survey import TRACE_HIDES, TRACE_MOST, Survey
from trowel.session import stage_table

#: Fill colour of each state on a map.
COLOURS = {"broken": "#c0392b", "deadend": "#d35400", "unfinished": "#e0b000", "maybe": "#95a5a6", "tested": "#2980b9", "live": "#27ae60", "confirmed": "#145a32"}
#: Lines of evidence for a connection, of a kind of signal, and outside packages, that a card shows.
EVIDENCE, HITS, OUTSIDE = 8, 6, 12
#: Signs of a file name, and of those at its end that stay; signs of a folder's name and of the last line.
NAME_CHARS, NAME_END, PLACE_CHARS = 18, 7, 22

STYLE = "body{font-family:sans-serif;margin:0;display:flex}main{flex:2;overflow:auto;padding:8px}aside{flex:1;padding:12px;max-height:100vh;overflow:auto;position:sticky;top:0;border-left:1px solid #ccc}.box{fill:#fafafa;stroke:#ccc}.card{fill:#fff;stroke-width:2}.node{cursor:pointer}.dim{opacity:.15}text{font-size:11px}.name{font-weight:bold}.off{display:none}.ribbon{fill:none;stroke:#888;opacity:.5}.wire{fill:none;stroke:#888}.chip{margin-right:6px;background:#fff;border:2px solid;border-radius:8px}.chip[aria-pressed=true]{font-weight:bold;background:#eee}#trace{display:none}.tracing #trace{display:block}.tracing #picture{display:none}table{border-spacing:8px 2px}code{white-space:pre-wrap}"

SCRIPT = """
const data = JSON.parse(document.getElementById('data').textContent);
const cards = [...document.querySelectorAll('.node')], panel = document.getElementById('panel');
const text = (tag, value) => { const e = document.createElement(tag); e.textContent = value; return e; };
function reach(seed, way) {
  const depth = new Map([[seed, 0]]), left = new Set();
  let ring = [seed];
  for (let level = 1; ring.length && depth.size <= data.most; level++) {
    const next = [];
    for (const name of ring) for (const other of data.modules[name][way]) {
      if (depth.has(other) || !data.modules[other]) continue;
      if (data.hides.includes(data.modules[other].state)) { left.add(other); continue; }
      depth.set(other, level); next.push(other);
    }
    ring = next;
  }
  return [depth, left.size];
}
const picture = document.getElementById('picture'), chart = document.getElementById('trace'), main = document.querySelector('main');
const chips = [...document.querySelectorAll('.chip')], home = new Map(cards.map(c => [c.dataset.name, c]));
const at = card => { const r = card.querySelector('.card'); return [+r.getAttribute('x'), +r.getAttribute('y')]; };
const made = (tag, values) => { const e = document.createElementNS('http://www.w3.org/2000/svg', tag); for (const [k, v] of Object.entries(values)) e.setAttribute(k, v); return e; };
let only = null;
function filter(state) {
  only = only === state ? null : state;
  for (const c of document.querySelectorAll('.node')) c.classList.toggle('off', only !== null && c.dataset.state !== only);
  for (const c of chips) c.setAttribute('aria-pressed', c.dataset.state === only);
}
function dim(names) { for (const c of cards) c.classList.toggle('dim', names !== null && !names.has(c.dataset.name)); }
function near(name) { const m = data.modules[name]; return new Set([name, ...m.uses, ...m.used_by]); }
// a second layout: rows by distance from the module, what leads to it above and what it leads to below
function draw(name, down, up) {
  const rows = new Map(), place = new Map(), [w, h, gap] = data.card;
  const put = (other, level) => rows.set(level, [...(rows.get(level) || []), other]);
  for (const [other, level] of up) put(other, -level);
  for (const [other, level] of down) if (level && !up.has(other)) put(other, level);
  const wide = Math.max(1, Math.floor((data.width + gap) / (w + gap)));
  let y = gap;
  chart.replaceChildren();
  for (const level of [...rows.keys()].sort((a, b) => a - b)) {
    const names = rows.get(level).sort();
    for (let first = 0; first < names.length; first += wide, y += h + gap) {
      const line = names.slice(first, first + wide), from = (data.width - line.length * (w + gap) + gap) / 2;
      line.forEach((other, i) => place.set(other, [from + i * (w + gap), y]));
    }
    y += gap;
  }
  for (const [other, [x, top]] of place) for (const next of data.modules[other].uses) {
    if (!place.has(next)) continue;
    const [nx, ny] = place.get(next), back = ny <= top, from = back ? top : top + h, to = back ? ny + h : ny, half = (from + to) / 2;
    chart.append(made('path', {class: 'wire', 'stroke-dasharray': back ? '4 3' : 'none', d: `M${x + w / 2},${from} V${half} H${nx + w / 2} V${to}`}));
  }
  for (const [other, [x, top]] of place) {
    const copy = home.get(other).cloneNode(true), [ox, oy] = at(home.get(other));
    copy.classList.remove('dim');
    copy.setAttribute('transform', `translate(${x - ox},${top - oy})`);
    listen(copy);
    chart.append(copy);
  }
  chart.setAttribute('width', data.width); chart.setAttribute('height', y);
  main.classList.add('tracing');
}
function open(name) {
  const m = data.modules[name], [down, missed] = reach(name, 'uses'), [up, above] = reach(name, 'used_by');
  dim(null);
  draw(name, down, up);
  panel.replaceChildren(text('h2', name), text('p', m.state + ', ' + m.loc + ' lines, score ' + m.score + ', ' + m.origin));
  if (m.verdict) panel.append(text('p', m.verdict));
  if (m.loaded_by) panel.append(text('p', m.loaded_by));
  panel.append(text('p', 'leads to ' + (down.size - 1) + ' (' + missed + ' left out), is led to by ' + (up.size - 1) + ' (' + above + ' left out)'));
  for (const [kind, found] of Object.entries(m.signals)) {
    panel.append(text('h3', kind));
    for (const [line, what] of found.lines) panel.append(text('div', (line ? 'line ' + line + ': ' : '') + what));
    if (found.more) panel.append(text('div', '... and ' + found.more + ' more'));
  }
  for (const [to, found] of Object.entries(m.links)) {
    panel.append(text('h3', 'uses ' + to));
    for (const [line, what] of found.lines) panel.append(text('code', line + ': ' + what + '\\n'));
    if (found.more) panel.append(text('div', '... and ' + found.more + ' more'));
  }
  if (m.external.length) panel.append(text('p', 'outside: ' + m.external.join(', ')));
}
function listen(card) {
  card.addEventListener('click', () => open(card.dataset.name));
  card.addEventListener('keydown', e => { if (e.key === 'Enter' || e.key === ' ') { e.preventDefault(); open(card.dataset.name); } });
}
for (const c of cards) {
  listen(c);
  c.addEventListener('mouseenter', () => { if (!panel.firstChild) dim(near(c.dataset.name)); });
  c.addEventListener('mouseleave', () => { if (!panel.firstChild) dim(null); });
}
for (const c of chips) c.addEventListener('click', () => filter(c.dataset.state));
document.addEventListener('keydown', e => {
  if (e.key !== 'Escape') return;
  panel.replaceChildren(); dim(null); main.classList.remove('tracing');
  if (only !== null) filter(only);
});
"""


def _lists(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the values of each, in order."""
    return df.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(value)).alias(name))


def _capped(df: DataFrame, group: list[str], text: str, most: int, name: str) -> DataFrame:
    """(key, name): for each first of group an array of (to, more, lines) by the second, with the first lines of it."""
    top = summaries.top_n_more(df, group, [F.asc("lineno"), F.asc(text)], most)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "lineno", text))), lambda x: F.struct(x["lineno"].alias("lineno"), x[text].alias("text")))
    each = top.groupBy(*group).agg(F.max("more").alias("more"), lines.alias("lines"))
    return each.groupBy(F.col(group[0]).alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(group[1]).alias("to"), "more", "lines"))).alias(name))


def _cards(survey: Survey) -> list:
    """All that a card shows, one row a module."""
    scores = survey.frontier.select("key", "score", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, b: a + b).alias("marks"))
    if survey.commits is not None:
        owner = survey.file_history.select(F.col("path").alias("relpath"), F.substring_index("authors", ",", 1).alias("owner"))
    else:
        owner = survey.modules.select("relpath", F.lit(None).cast("string").alias("owner"))
    joined = survey.modules.select("key", "relpath", "loc").join(survey.states, "key").join(survey.origins.select("key", "origin"), "key").join(scores, "key", "left").join(owner, "relpath", "left").join(survey.cards.select("key", "x", "y"), "key")
    file, folder = F.substring_index("relpath", "/", -1), F.regexp_extract("relpath", "^(.*/)[^/]*$", 1)
    badge = F.when(F.col("origin").isin("untracked", "vendored"), F.col("origin")).otherwise("")
    size = T.counted(F.col("loc"), "line")
    name = F.when(F.length(file) > NAME_CHARS, F.concat(F.substring(file, 1, NAME_CHARS - NAME_END - 1), F.lit("…"), F.right(file, F.lit(NAME_END)))).otherwise(file)
    return joined.select(
        "key", "relpath", "loc", "state", "origin", "x", "y", badge.alias("badge"), name.alias("name"), T.clip_end(F.when(folder == "", "./").otherwise(folder), PLACE_CHARS).alias("place"),
        T.meta_line(size, F.coalesce("owner", F.lit("no history")), badge, PLACE_CHARS).alias("meta"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("marks", F.lit(0)).alias("marks"), T.size_share(F.col("loc")).alias("share"),
    ).orderBy("key").collect()


def svg(survey: Survey, cards: Callable[[], list] | None = None) -> str:
    """The picture: every module has a card, every folder a box, and every pair of folders with imports a ribbon. cards: gives what _cards does."""
    esc = html.escape
    boxes = survey.boxes.orderBy("y", "x").collect()
    height = max((b.y + b.h for b in boxes), default=0)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{G.CHART_W}" height="{height}" role="img"><defs><marker id="end" viewBox="0 0 6 6" refX="6" refY="3" markerWidth="6" markerHeight="6" orient="auto"><path d="M0,0 L6,3 L0,6 z" fill="#888"/></marker></defs>']
    out += [f'<g><rect class="box" x="{b.x}" y="{b.y}" width="{b.w}" height="{b.h}" rx="6"/><text x="{b.x + G.BOX_PAD}" y="{b.y + 17}">{esc(b.folder)} ({b.modules}, {b.loc} lines)</text></g>' for b in boxes]
    for r in survey.ribbon_paths.orderBy(F.desc("n"), "src_folder", "dst_folder").collect():
        out.append(f'<path class="ribbon" data-n="{r.n}" stroke-width="{r.weight:.1f}" marker-end="url(#end)" d="M{r.sx:.1f},{r.sy:.1f} Q{r.mx:.1f},{r.my:.1f} {r.ex:.1f},{r.ey:.1f}"><title>{esc(r.src_folder)} imports {esc(r.dst_folder)}, {r.n} times</title></path>')
    for c in cards() if cards else _cards(survey):
        bar = max(2, round((G.CARD_W - 18) * c.share)) if c.share else 0
        out.append(
            f'<g class="node" data-name="{esc(c.key)}" data-state="{c.state}" tabindex="0" role="button" aria-label="{esc(c.key)}: {c.state}"><title>{esc(c.relpath)}</title>'
            f'<rect class="card" x="{c.x}" y="{c.y}" width="{G.CARD_W}" height="{G.CARD_H}" rx="8" stroke="{COLOURS[c.state]}"/>'
            f'<text class="name" x="{c.x + 9}" y="{c.y + 20}">{esc(c["name"])}</text><text x="{c.x + 9}" y="{c.y + 37}">{esc(c.place)}</text><text x="{c.x + 9}" y="{c.y + 53}">{esc(c.meta)}</text>'
            f'<text x="{c.x + G.CARD_W - 9}" y="{c.y + 20}" text-anchor="end">{c.marks or ""}</text><text x="{c.x + G.CARD_W - 9}" y="{c.y + 53}" text-anchor="end">{c.badge}</text>'
            f'<rect x="{c.x + 9}" y="{c.y + G.CARD_H - 12}" width="{bar}" height="3" fill="{COLOURS[c.state]}"/></g>'
        )
    return "".join(out) + "</svg>"


def clicks(survey: Survey) -> DataFrame:
    """What a click on a module shows, a row a module: lists in order, of evidence and signals as many lines as a card has place for. For maps of any size."""
    base = survey.modules.select("key", "relpath", "loc").join(survey.states, "key").join(survey.origins.select("key", "origin"), "key").join(survey.frontier.select("key", "score"), "key", "left")
    base = base.groupBy("key").agg(F.min(F.struct("relpath", "state", "origin", "loc", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select("key", "m.*")
    said = survey.attempt_sentences.where("verdict = 'restart'").groupBy(F.col("resume_at").alias("key")).agg(F.max(F.struct("stake", "effort")).alias("said"))
    resume = F.concat(F.lit("resume here: "), "said.stake", F.when(F.col("said.effort") != "", F.concat(F.lit("; "), "said.effort")).otherwise(""))
    seen = F.concat("verdict", F.lit(": "), F.col("percent").cast("string"), F.lit(" % written; see "), "resume_at")
    verdict = survey.verdicts.join(said, "key", "left").select("key", F.when((F.col("verdict") == "resume") & F.col("said").isNotNull(), resume).otherwise(seen).alias("verdict"))
    why = F.concat("name", F.lit(", "), "why", F.when(F.col("proven"), "").otherwise(" (inferred)"))
    loaded = survey.loaded_by.groupBy("key").agg(F.min_by(why, F.struct(~F.col("proven"), why)).alias("loaded_by"))
    evidence = stage_table(survey.spark, survey.evidence, "evidence")  # read twice
    parts = [
        _lists(survey.edges, "src", "dst", "uses"), _lists(survey.edges, "dst", "src", "used_by"), _lists(survey.external, "src", "root", "external").withColumn("external", F.slice("external", 1, OUTSIDE)),
        _capped(survey.signals, ["key", "kind"], "text", HITS, "signals"), _capped(evidence, ["src", "dst"], "text", EVIDENCE, "links"), verdict, loaded,
    ]
    joined = reduce(lambda df, part: df.join(part, "key", "left"), parts, base)
    return joined.withColumns({c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("uses", "used_by", "external", "signals", "links")})


def payload(survey: Survey) -> dict:
    """What a click shows, by module; it can be put into a page by escaped_json."""
    found = lambda listed: {x["to"]: {"lines": [[line["lineno"], line["text"]] for line in x["lines"]], "more": x["more"]} for x in listed}
    rows = sorted((r.asDict() for r in clicks(survey).collect()), key=lambda r: r["key"])
    modules = {r.pop("key"): r | {"signals": found(r["signals"]), "links": found(r["links"])} for r in rows}
    return {"modules": modules, "hides": TRACE_HIDES, "most": TRACE_MOST, "card": [G.CARD_W, G.CARD_H, G.CARD_GAP], "width": G.CHART_W}


def escaped_json(value: object) -> str:
    """JSON that no markup can end."""
    return json.dumps(value, default=str).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def html_map(survey: Survey, title: str = "survey") -> str:
    """One self-contained page: the picture, a panel, what a click shows, and the script that traces."""
    asked = [lambda: _cards(survey), lambda: survey.opening.first(), lambda: {r.state: r.modules for r in survey.state_tally.collect()}, lambda: survey.held_back.orderBy(F.desc("modules"), "loader").collect()]
    with ThreadPoolExecutor(len(asked) + 2) as pool:
        cards, *rest = (pool.submit(f) for f in asked)
        picture, shown = pool.submit(svg, survey, cards.result), pool.submit(payload, survey)
    opening, tally, held = (f.result() for f in rest)
    esc = html.escape
    states = "".join(f'<button class="chip" data-state="{s}" aria-pressed="false" style="border-color:{COLOURS[s]}">{s} {tally[s]}</button>' for s in COLOURS if s in tally)
    loaders = f"<p>{sum(h.modules for h in held)} modules are loaded by name: {esc(', '.join(f'{h.loader} ({h.modules})' for h in held))}; {sum(h.proven for h in held)} of them by declaration.</p>" if held else ""
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{esc(title)}</title><style>{STYLE}</style></head><body><main><h1>{esc(title)}</h1><p>{esc(opening.finding or "")}. {esc(opening.coverage or "")}</p><p>{states}</p>{loaders}<div id="picture">'
        f'{picture.result()}</div><svg xmlns="http://www.w3.org/2000/svg" id="trace"></svg></main><aside id="panel"></aside><script type="application/json" id="data">{escaped_json(shown.result())}</script><script>{SCRIPT}</script></body></html>'
    )
