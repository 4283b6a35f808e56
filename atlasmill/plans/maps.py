"""Maps of results: a page that shows its rows by itself, and tiles by level for results of any number.

Tiles are those of web maps: at level z the square world has 2^z by 2^z tiles, and a tile's quadkey names it with a digit
for each level, so tiles that are near each other sort together and a part of a key is the tile above.
"""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions import geometry as G
from atlasmill.functions import rules as R
from atlasmill.operators import has_boundary

#: Beyond it the square world of web maps ends.
MAX_LATITUDE = 85.0511287798066
#: Steps across a tile to which corners of rings are rounded.
STEPS = 256


def tile_place(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    """Column and row of a place at a level, in tiles and their fractions, from the north-west; beyond the world its border."""
    side = float(1 << level)
    inside = F.radians(F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE)))
    y = (1 - F.ln(F.tan(inside) + 1 / F.cos(inside)) / math.pi) / 2 * side
    held = lambda v: F.greatest(F.least(v, F.lit(side - 1e-9)), F.lit(0.0))
    return held((lon + 180) / 360 * side), held(y)


def quadkey(x: Column, y: Column, level: int) -> Column:
    """The key of tile (x, y); of level 0 the empty text."""
    digit = lambda k: (F.shiftright(x.cast("int"), k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y.cast("int"), k).bitwiseAND(F.lit(1))).cast("string")
    return F.concat(*[digit(k) for k in range(level - 1, -1, -1)]) if level else F.lit("")


def simplified(ring: Column, level: int) -> Column:
    """ring without corners that a level can't tell apart: rounded to STEPS a tile, repeats dropped; empty if under three are left."""
    step = 360.0 / (1 << level) / STEPS
    rounded = F.transform(ring, lambda p: G.point(F.round(p["x"] / step) * step, F.round(p["y"] / step) * step))
    return G.bind(G.cleaned(rounded), lambda r: F.when(F.size(r) >= 3, r).otherwise(F.array().cast(G.RING)))


def tiles(results: DataFrame, levels: range | list[int]) -> DataFrame:
    """(level, quadkey, seq, region_id, region_name, status, boundary, lon, lat, polygon): each located result in every tile it touches.

    A result lies in the tiles of its ring's box, or in that of its centre; its ring is simplified for the level. Rows
    are rows of the results, so nothing is collected, and tiles of a level are independent of their number.
    """
    located = results.where(F.col("center_lon").isNotNull() & F.col("center_lat").isNotNull())
    ring = F.coalesce("polygon", F.array().cast(G.RING))
    here = G.point(F.col("center_lon"), F.col("center_lat"))
    boxed = located.withColumn("_box", G.bbox(F.when(F.size(ring) > 0, F.concat(ring, F.array(here))).otherwise(F.array(here))))
    out = None
    for level in levels:
        x0, y0 = tile_place(F.col("_box.x0"), F.col("_box.y1"), level)
        x1, y1 = tile_place(F.col("_box.x1"), F.col("_box.y0"), level)
        across = lambda a, b: F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int"))
        each = boxed.select("*", F.explode(across(x0, x1)).alias("_x")).select("*", F.explode(across(y0, y1)).alias("_y"))
        rows = each.select(
            F.lit(level).alias("level"), quadkey(F.col("_x"), F.col("_y"), level).alias("quadkey"), "seq", "region_id", "region_name", "status", has_boundary(F.col("polygon")).alias("boundary"),
            F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat"), simplified(ring, level).alias("polygon"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def write_tiles(results: DataFrame, path: str, levels: range | list[int]) -> None:
    """Tiles as Parquet by level, sorted by key, so that reading a tile skips all files and row groups but its own."""
    made = tiles(results, levels)
    made.repartitionByRange("level", "quadkey").sortWithinPartitions("level", "quadkey", "seq").write.mode("overwrite").partitionBy("level").parquet(path)


def tile(spark: SparkSession, path: str, level: int, key: str) -> DataFrame:
    """The rows of a written tile, or of all tiles below it if the key is shorter than the level."""
    rows = spark.read.parquet(path).where(F.col("level") == level)
    return rows.where(F.col("quadkey") == key) if len(key) == level else rows.where(F.col("quadkey").startswith(key))


STYLE = """html,body{height:100%;margin:0;font-family:sans-serif;font-size:13px}svg{position:absolute;left:300px;top:0;width:calc(100% - 300px);height:100%;background:#f4f6f8}
#side{position:absolute;left:0;top:0;width:300px;height:100%;display:flex;flex-direction:column}#side p{margin:6px 8px}button.on{background:#1e6fd9;color:#fff}
#list{flex:1;overflow:auto;margin:0;padding:0;list-style:none}#list li{padding:4px 8px;cursor:pointer;border-bottom:1px solid #eee}#info{padding:8px;white-space:pre-line;border-top:1px solid #ccc;min-height:8em}"""

SCRIPT = """
const view={status:null,boundary:null,text:''},color=r=>r.status===GOOD?'#00965a':'#e08a00',has=r=>(r.polygon||[]).length>=3;
const fits=r=>(view.status===null||r.status===view.status)&&(view.boundary===null||has(r)===view.boundary)&&(!view.text||((r.name||'')+' '+(r.input||'')).toLowerCase().includes(view.text));
const svg=document.querySelector('svg'),list=document.getElementById('list'),info=document.getElementById('info'),make=(n,a)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',n);for(const k in a)e.setAttribute(k,a[k]);return e};
const tell=r=>{info.textContent=[r.name+' ('+r.id+')',r.status,r.input,r.selected||'-',r.type,r.subs||'-',r.detail||'-',r.message||'',r.lon.toFixed(6)+', '+r.lat.toFixed(6),(r.polygon||[]).length+' corners'].join('\\n')};
function frame(rows){const xs=[],ys=[];rows.forEach(r=>{xs.push(r.lon);ys.push(-r.lat);(r.polygon||[]).forEach(p=>{xs.push(p[0]);ys.push(-p[1])})});if(!xs.length)return;
const low=v=>v.reduce((a,b)=>Math.min(a,b)),high=v=>v.reduce((a,b)=>Math.max(a,b)),w=Math.max(high(xs)-low(xs),high(ys)-low(ys),1e-3);svg.setAttribute('viewBox',[low(xs)-w*.05,low(ys)-w*.05,w*1.1,w*1.1].join(' '));svg.dataset.w=w}
function show(){const rows=DATA.filter(fits);svg.textContent='';list.textContent='';frame(rows);const w=+svg.dataset.w||1;
rows.forEach(r=>{if(has(r)){const p=make('polygon',{points:r.polygon.map(q=>q[0]+','+-q[1]).join(' '),fill:color(r),'fill-opacity':.25,stroke:color(r),'stroke-width':w/600});p.onclick=()=>tell(r);svg.appendChild(p)}
const c=make('circle',{cx:r.lon,cy:-r.lat,r:w/200,fill:color(r)});c.onclick=()=>tell(r);svg.appendChild(c);
const li=document.createElement('li');li.textContent=r.name;li.onclick=()=>{frame([r]);tell(r);navigator.clipboard&&navigator.clipboard.writeText(r.name)};list.appendChild(li)})}
document.querySelectorAll('button').forEach(b=>b.onclick=()=>{const [k,v]=JSON.parse(b.dataset.set);view[k]=v;b.parentNode.querySelectorAll('button').forEach(o=>o.classList.toggle('on',o===b));show()});
document.getElementById('q').oninput=e=>{view.text=e.target.value.trim().toLowerCase();show()};show();
"""


def page(rows: list[str], title: str, key: str) -> str:
    """A page of rows, each the text of a JSON object: rings and centres by status, with views by status and boundary."""
    data = ("[" + ",".join(rows) + "]").replace("</", "<\\/")
    button = lambda label, kind, value, on=False: f"<button{' class=on' if on else ''} data-set='{html.escape(json.dumps([kind, value], ensure_ascii=False), quote=True)}'>{label}</button>"
    views = "<p>" + button("全部", "status", None, True) + button(R.STATUS_SUCCESS, "status", R.STATUS_SUCCESS) + button(R.STATUS_LOW, "status", R.STATUS_LOW) + "</p>"
    views += "<p>" + button("全部", "boundary", None, True) + button("有边界", "boundary", True) + button("无边界", "boundary", False) + "</p>"
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><div id="side">{views}<p><input id="q"></p>'
        f'<ul id="list"></ul><div id="info"></div></div><svg preserveAspectRatio="xMidYMid"></svg><script>const KEY={json.dumps(key)};const GOOD={json.dumps(R.STATUS_SUCCESS)};const DATA={data};{SCRIPT.strip()}</script></body></html>'
    )
