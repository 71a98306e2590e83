"""Registry of queries, and the SQL of the derived catalogue that their oracles start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its name, with its SQL for the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


SHADES = """
raw as (
  select 'P' || cast(p_partkey // 4 as varchar) as product_id, cast(p_partkey as varchar) as shade_id, p_brand as brand_name,
    p_type || ' ' || p_name || case when p_partkey % 40 = 7 then ' refill' when p_partkey % 200 = 11 then ' étui' else '' end as product_name,
    p_name || ' ' || cast(p_size as varchar) as shade_name, 'https://shop.example/p/item-P' || cast(p_partkey // 4 as varchar) || '.html' as url,
    cast(p_partkey % 8 as int) as cluster_id,
    case when p_partkey % 97 = 5 then 'n/a' when p_partkey % 89 = 3 then '300,10,10'
      else (120 + (p_partkey*37 + p_size*11) % 136) || ',' || (20 + (p_partkey*53 + p_size*7) % 160) || ',' || (20 + (p_partkey*29 + p_size*13) % 170) end as chip_rgb
  from part),
three as (select *, string_split(chip_rgb, ',') as ch from raw),
rgb as (select * exclude ch, case when ok then cast(ch[1] as int) end as r, case when ok then cast(ch[2] as int) end as g, case when ok then cast(ch[3] as int) end as b
  from (select *, len(ch) = 3 and try_cast(ch[1] as int) between 0 and 255 and try_cast(ch[2] as int) between 0 and 255 and try_cast(ch[3] as int) between 0 and 255 as ok from three)),
lin as (select *, '#' || lower(printf('%02x%02x%02x', r, g, b)) as chip_hex,
    case when r/255e0 <= 0.04045 then r/255e0/12.92 else power((r/255e0+0.055)/1.055, 2.4) end as lr,
    case when g/255e0 <= 0.04045 then g/255e0/12.92 else power((g/255e0+0.055)/1.055, 2.4) end as lg,
    case when b/255e0 <= 0.04045 then b/255e0/12.92 else power((b/255e0+0.055)/1.055, 2.4) end as lb from rgb),
xyz as (select *, (0.4124564*lr + 0.3575761*lg + 0.1804375*lb)/0.95047 as x1, 0.2126729*lr + 0.7151522*lg + 0.0721750*lb as y1, (0.0193339*lr + 0.1191920*lg + 0.9503041*lb)/1.08883 as z1 from lin),
fff as (select *, case when x1 > 216e0/24389 then cbrt(x1) else x1*841e0/108 + 4e0/29 end as fx, case when y1 > 216e0/24389 then cbrt(y1) else y1*841e0/108 + 4e0/29 end as fy,
    case when z1 > 216e0/24389 then cbrt(z1) else z1*841e0/108 + 4e0/29 end as fz from xyz),
lab as (select product_id, shade_id, brand_name, product_name, shade_name, url, cluster_id, chip_rgb, case when r is not null then chip_hex end as chip_hex, r, g, b,
    116*fy - 16 as L_lab, 500*(fx - fy) as a_lab, 200*(fy - fz) as b_lab, y1 as Y_rel from fff),
mm as (select *, sqrt(a_lab*a_lab + b_lab*b_lab) as C_lab, ((degrees(atan2(round(b_lab, 10), round(a_lab, 10))) % 360) + 360) % 360 as H_lab_deg,
    greatest(r, g, b)/255e0 as hi, least(r, g, b)/255e0 as lo from lab),
shades as (select * exclude (hi, lo), 100 - L_lab as depth, b_lab - 0.5*a_lab as warmth, C_lab/greatest(L_lab, 1e-6) as sat_eff, (hi + lo)/2 as light_hsl,
    case when r is null then null when hi = lo then 0.0 else (hi - lo)/(1 - abs(hi + lo - 1)) end as sat_hsl,
    case when r is null then null when hi = lo then 0.0 else (60*(case when b/255e0 = hi then (r-g)/255e0/(hi-lo) + 4 when g/255e0 = hi then (b-r)/255e0/(hi-lo) + 2 else (g-b)/255e0/(hi-lo) end) % 360 + 360) % 360 end as hue_hsl_deg,
    case when r is null then null when hi = lo then 0.0 else (60*(case when r/255e0 = hi then (g-b)/255e0/(hi-lo) when g/255e0 = hi then (b-r)/255e0/(hi-lo) + 2 else (r-g)/255e0/(hi-lo) + 4 end) % 360 + 360) % 360 end as hue_hsv_deg,
    0.3*sqrt(power((r-g)/255e0, 2) + power((r+g)/2/255e0 - b/255e0, 2)) as colorfulness from mm)
"""
PROBS = """
d as (select s.*, pr.label, exp(-(power(L_lab-pr.l0,2)+power(a_lab-pr.a0,2)+power(b_lab-pr.b0,2))/200e0) as e from shades s
  cross join (values ('brown',39.3e0,36.1e0,20.5e0),('coral',55e0,50e0,34e0),('pink',50e0,55e0,0e0),('red',42e0,62e0,38e0),('taupe',55e0,12e0,12e0)) as pr(label,l0,a0,b0) where r is not null),
probs as (select *, e/(sum(e) over (partition by product_id, shade_id)) as p from d)
"""
_ANCHOR_LIST = "('red','#ff0000'),('pink','#fe46a5'),('fuchsia','#ff00ff'),('purple','#7e1e9c'),('mauve','#e0b0ff'),('orange','#ff8000'),('coral','#ff7f50'),('peach','#ffe5b4'),('brown','#964b00'),('nude','#e6c2b3'),('beige','#a67b5b'),('blue','#0000ff'),('green','#15b01a'),('yellow','#f5bd1f'),('black','#3b3c36'),('white','#ffffff'),('gray','#86949f')"
ANCHORS = f"""
an0 as (select *, ('0x' || anchor_hex[2:3])::int/255e0 as ar, ('0x' || anchor_hex[4:5])::int/255e0 as ag, ('0x' || anchor_hex[6:7])::int/255e0 as ab from (values {_ANCHOR_LIST}) v(query_id, anchor_hex)),
an1 as (select *, case when ar <= 0.04045 then ar/12.92 else power((ar+0.055)/1.055, 2.4) end as lr, case when ag <= 0.04045 then ag/12.92 else power((ag+0.055)/1.055, 2.4) end as lg, case when ab <= 0.04045 then ab/12.92 else power((ab+0.055)/1.055, 2.4) end as lb from an0),
an2 as (select *, (0.4124564*lr + 0.3575761*lg + 0.1804375*lb)/0.95047 as x1, 0.2126729*lr + 0.7151522*lg + 0.0721750*lb as y1, (0.0193339*lr + 0.1191920*lg + 0.9503041*lb)/1.08883 as z1, greatest(ar,ag,ab) as hi, least(ar,ag,ab) as lo from an1),
an3 as (select *, case when x1 > 216e0/24389 then cbrt(x1) else x1*841e0/108 + 4e0/29 end as fx, case when y1 > 216e0/24389 then cbrt(y1) else y1*841e0/108 + 4e0/29 end as fy, case when z1 > 216e0/24389 then cbrt(z1) else z1*841e0/108 + 4e0/29 end as fz from an2),
anchors as (select query_id, anchor_hex, 116*fy - 16 as anchor_L, 500*(fx-fy) as anchor_a, 200*(fy-fz) as anchor_b, sqrt(power(500*(fx-fy),2)+power(200*(fy-fz),2)) as anchor_C,
  case when hi = lo then 0.0 else (60*(case when ar = hi then (ag-ab)/(hi-lo) when ag = hi then (ab-ar)/(hi-lo) + 2 else (ar-ag)/(hi-lo) + 4 end) % 360 + 360) % 360 end as anchor_hue from an3)
"""
PAIRS = """
p1 as (select s.*, a.*, (sqrt(a_lab*a_lab+b_lab*b_lab) + anchor_C)/2 as cm from shades s cross join anchors a where r is not null),
p2 as (select *, 1.5 - 0.5*sqrt(power(cm,7)/(power(cm,7) + power(25e0,7) + 1e-12)) as gg from p1),
p3 as (select *, sqrt(power(gg*a_lab,2)+b_lab*b_lab) as c1, sqrt(power(gg*anchor_a,2)+anchor_b*anchor_b) as c2, ((degrees(atan2(b_lab, gg*a_lab)) % 360)+360)%360 as h1, ((degrees(atan2(anchor_b, gg*anchor_a)) % 360)+360)%360 as h2 from p2),
p4 as (select *, (c1+c2)/2 as cb, case when h1-h2 > 180 then h1-h2-360 when h1-h2 < -180 then h1-h2+360 else h1-h2 end as dh, ((h1+h2+case when abs(h1-h2) > 180 then 360 else 0 end)/2) % 360 as hb, power((L_lab+anchor_L)/2-50,2) as l2 from p3),
p5 as (select *, 1 - 0.17*cos(radians(hb-30)) + 0.24*cos(radians(2*hb)) + 0.32*cos(radians(3*hb+6)) - 0.20*cos(radians(4*hb-63)) as t,
  -sin(radians(60*exp(-power((hb-275)/25,2))))*2*sqrt(power(cb,7)/(power(cb,7)+power(25e0,7)+1e-12)) as rt from p4),
p6 as (select *, (L_lab-anchor_L)/(1+0.015*l2/sqrt(20+l2)) as dl, (c1-c2)/(1+0.045*cb) as dc, 2*sqrt(c1*c2)*sin(radians(dh/2))/(1+0.015*cb*t) as dhh from p5),
pairs as (select * exclude (cm, gg, c1, c2, h1, h2, cb, dh, hb, l2, t, rt, dl, dc, dhh), sqrt(dl*dl + dc*dc + dhh*dhh + rt*dc*dhh) as de00, case when anchor_C < 18 then 12.0 else 18.0 end as base from p6)
"""


def with_(*parts: str, select: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n" + select
