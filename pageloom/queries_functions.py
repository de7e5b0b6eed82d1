"""Registered queries of the function library, each over a whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import containers, js, numeric, strings, urls
from pageloom.queries import _t, query

_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"


@query("""select doc_id, starts_with(text, 'The') as starts, text[5:7] = 'the' as starts_at, ends_with(text, '.') as ends, repeat(lang, 3) as repeated, concat(lang, '-', source, '-', n_chars) as joined, md5(nfc_normalize(text)) as nfc,
length(string_split(text, ''))::int as points, md5(array_to_string(list_reverse(string_split(text, '')), '')) as reversed, length(text) - 1 - coalesce(nullif(strpos(reverse(text), 'e'), 0) - 1, length(text)) as last_e,
trim(text, ' \t\n\r\v\f') as trimmed, unicode(text[1]) as code, md5(upper(replace(text, 'ß', 's'))) as up, text[-1] as at_end, md5(substr(text, greatest(length(text) - 8 + 1, 1), 4)) as part from documents""")
def js_string_methods(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select(
        "doc_id", strings.starts_with(t, "The").alias("starts"), strings.starts_with(t, "the", 4).alias("starts_at"), strings.ends_with(t, ".").alias("ends"), strings.repeat(F.col("lang"), 3).alias("repeated"),
        strings.concat(F.col("lang"), F.lit("-"), F.col("source"), F.lit("-"), F.col("n_chars")).alias("joined"), F.md5(strings.normalize(t)).alias("nfc"), F.size(strings.code_points(t)).alias("points"), F.md5(js.array_join(F.reverse(strings.code_points(t)), "")).alias("reversed"),
        js.last_index_of(t, "e").cast("long").alias("last_e"), js.trim(t).alias("trimmed"), js.code_point_at(t, 0).alias("code"), F.md5(F.upper(js.replace_all(t, "ß", "s"))).alias("up"), js.at(t, -1).alias("at_end"), F.md5(js.substr(t, -8, 4)).alias("part"),
    )


@query(r"""select doc_id, length(string_split_regex(text, '[.!?]\s+'))::int as sentences, md5(regexp_replace(text, '([aeiou])([rnst])', '<\2\1>', 'g')) as turned, md5(regexp_replace(text, '[aeiou]', '_')) as first_vowel, regexp_matches(text, '[0-9]{3}') as has_number,
case when regexp_matches(text, '(\w+)@(\w+)') then [regexp_extract(text, '(\w+)@(\w+)', 0), regexp_extract(text, '(\w+)@(\w+)', 1), regexp_extract(text, '(\w+)@(\w+)', 2)] end as mail,
list_transform(list_zip(regexp_extract_all(text, '([0-9])([0-9])', 0), regexp_extract_all(text, '([0-9])([0-9])', 1), regexp_extract_all(text, '([0-9])([0-9])', 2)), lambda z: [z[1], z[2], z[3]]) as pairs,
case when regexp_matches(text, '[0-9]') then length(regexp_extract(text, '^([^0-9]*)', 1)) else -1 end::int as digit_at from documents""")
def js_regular_expressions(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select(
        "doc_id", F.size(strings.split_regex(t, r"[.!?]\s+")).alias("sentences"), F.md5(strings.replace_regex(t, "([aeiou])([rnst])", "<$2$1>")).alias("turned"), F.md5(strings.replace_regex(t, "[aeiou]", "_", every=False)).alias("first_vowel"), strings.test(t, "[0-9]{3}").alias("has_number"),
        strings.exec_(t, r"(\w+)@(\w+)", 2).alias("mail"), strings.match_groups(t, "([0-9])([0-9])", 2).alias("pairs"), js.search(t, "[0-9]").alias("digit_at"),
    )


_COMPONENT = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
_URI = _COMPONENT
for _c in ";/?:@&=+$,#":
    _URI = f"replace({_URI}, '%{ord(_c):02X}', '{_c}')"


@query(f"""select page_id, {_COMPONENT.format('url')} as component, {_URI.format("url || ' é#x'")} as uri, url as back, md5({_COMPONENT.format('html')}) as html_component, octet_length(encode(html))::int as n_bytes, md5(html) as decoded,
sha1(html) as sha1, sha256(html) as sha256, base64(encode(url)) as b64, url as unb64, 36::int as uuid_length from pages""")
def js_uri_and_bytes(spark, d):
    u, h = F.col("url"), F.col("html")
    units = F.decode(F.encode(u, "UTF-8"), "ISO-8859-1")  # a unit for each byte, as btoa takes them
    return _t(spark, d, "pages").select(
        "page_id", js.encode_uri_component(u).alias("component"), strings.encode_uri(F.concat(u, F.lit(" é#x"))).alias("uri"), strings.decode_uri(strings.encode_uri(u)).alias("back"), F.md5(js.encode_uri_component(h)).alias("html_component"), F.size(strings.text_encode(h)).alias("n_bytes"),
        F.md5(strings.text_decode(F.encode(h, "UTF-8"))).alias("decoded"), strings.digest(h, "SHA-1").alias("sha1"), strings.digest(h, "SHA-256").alias("sha256"), js.btoa(units).alias("b64"), strings.text_decode(F.encode(js.atob(js.btoa(units)), "ISO-8859-1")).alias("unb64"), F.length(strings.random_uuid()).alias("uuid_length"),
    )


@query("""select doc_id, unicode(text[1])::int as unit, chr(unicode(text[1])) as back, chr(97 + (doc_id % 26)::int) || chr(65 + (doc_id % 26)::int) as made, [unicode(lang[1]), unicode(lang[2])] as units, length(lang)::int as n from documents where length(text) > 0 and unicode(text[1]) < 55296""")
def js_char_codes(spark, d):
    t, k = F.col("text"), F.col("doc_id") % 26
    rows = _t(spark, d, "documents").where((F.length("text") > 0) & (js.code_point_at(t, 0) < 55296))
    return rows.select("doc_id", strings.char_code_at(t, 0).alias("unit"), strings.from_char_code(F.array(strings.char_code_at(t, 0))).alias("back"), strings.from_char_code(F.array(k + 97, k + 65)).alias("made"), F.array(strings.char_code_at(F.col("lang"), 0), strings.char_code_at(F.col("lang"), 1)).alias("units"), strings.utf16_length(F.col("lang")).alias("n"))


@query("""select l_orderkey, l_linenumber, round(sin(l_tax * 10), 9) as sin, round(cos(l_tax * 10), 9) as cos, round(tan(l_tax), 9) as tan, round(asin(l_discount), 9) as asin, round(acos(l_discount), 9) as acos, round(atan(l_quantity), 9) as atan,
round(atan2(l_tax, l_discount + 1), 9) as atan2, round(exp(l_discount), 9) as exp, round(ln(l_quantity), 9) as ln, round(log2(l_quantity), 9) as log2, round(log10(l_quantity), 9) as log10, round(sqrt(l_quantity), 9) as sqrt, round(cbrt(l_quantity), 9) as cbrt,
abs(l_quantity - 25) as abs, ceil(l_extendedprice)::double as ceil, floor(l_extendedprice)::double as floor, trunc(l_quantity - 25.5)::double + 0.0 as trunc, round(pow(l_quantity, 1.5), 6) as power, round(sqrt(l_tax * l_tax + l_discount * l_discount), 9) as hypot,
greatest(l_quantity, l_tax * 500) as high, round(l_quantity * 3.141592653589793, 9) as around, (l_orderkey * 31) % 7 as imul from lineitem""")
def js_math_functions(spark, d):
    q, e, t, c = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    r = lambda x, name, n=9: F.round(x, n).alias(name)
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r(numeric.math_of("sin", t * 10), "sin"), r(numeric.math_of("cos", t * 10), "cos"), r(numeric.math_of("tan", t), "tan"), r(numeric.math_of("asin", c), "asin"), r(numeric.math_of("acos", c), "acos"), r(numeric.math_of("atan", q), "atan"), r(numeric.atan2(t, c + 1), "atan2"),
        r(numeric.math_of("exp", c), "exp"), r(js.log(q), "ln"), r(numeric.log2(q), "log2"), r(numeric.log10(q), "log10"), r(js.sqrt(q), "sqrt"), r(numeric.math_of("cbrt", q), "cbrt"), numeric.math_of("abs", q - 25).alias("abs"), numeric.ceil(e).alias("ceil"), numeric.floor(e).alias("floor"),
        (numeric.trunc(q - 25.5) + 0.0).alias("trunc"), r(numeric.power(q, F.lit(1.5)), "power", 6), r(numeric.hypot(t, c), "hypot"), js.max_(q, t * 500).alias("high"), r(q * numeric.constant("PI"), "around"), (numeric.imul(F.col("l_orderkey"), F.lit(31)).cast("long") % 7).alias("imul"),
    )


@query("""select o_orderkey, o_orderkey::varchar || o_orderstatus as plus_text, o_totalprice + o_custkey as plus_number, 'true' || (o_orderkey::varchar) as plus_boolean, o_orderkey::varchar = (o_orderkey::double)::bigint::varchar as loose, o_custkey = o_orderkey as equal, o_orderpriority < '3' as less_text,
o_totalprice < 150000 as less_number, o_orderstatus <> '' as truthy_text, o_custkey % 5 <> 0 as truthy_number, (o_orderkey % 3 = 0)::varchar as flag, try_cast(o_orderpriority[1] as double) as number, true as is_nan, o_custkey::varchar as as_text,
(o_orderkey::hugeint * 123456789012345678 // 1000)::varchar as big, (o_orderkey::hugeint * 123456789012345678 % 1000)::varchar as rest, coalesce(nullif(o_orderstatus, 'O'), 'open') as either, o_totalprice = o_totalprice as same from orders""")
def js_operators(spark, d):
    key, price, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    big = key.cast("decimal(38,0)") * F.lit("123456789012345678").cast("decimal(18,0)")
    return _t(spark, d, "orders").select(
        "o_orderkey", numeric.plus(key, status, ("number", "string")).alias("plus_text"), numeric.plus(price, F.col("o_custkey"), ("number", "number")).alias("plus_number"), numeric.plus(F.lit(True), key.cast("string"), ("boolean", "string")).alias("plus_boolean"),
        numeric.loose_equal(key, key.cast("string"), ("number", "string")).alias("loose"), numeric.loose_equal(F.col("o_custkey"), key, ("number", "number")).alias("equal"), numeric.less(F.col("o_orderpriority"), F.lit("3"), ("string", "string")).alias("less_text"), numeric.less(price, F.lit("150000"), ("number", "string")).alias("less_number"),
        js.truthy(status, "string").alias("truthy_text"), js.truthy(F.col("o_custkey") % 5, "number").alias("truthy_number"), numeric.boolean_string(key % 3 == 0).alias("flag"), js.to_number(js.char_at(F.col("o_orderpriority"), 0)).alias("number"), numeric.is_nan(F.col("o_orderpriority"), "string").alias("is_nan"),
        numeric.string_of(F.col("o_custkey"), "number").alias("as_text"), numeric.big_divide(big, F.lit(1000)).cast("string").alias("big"), numeric.big_remainder(big, F.lit(1000)).cast("string").alias("rest"), F.coalesce(F.nullif(status, F.lit("O")), F.lit("open")).alias("either"), js.strict_equal(price, price).alias("same"),
    )


@query("""select event_id, value = floor(value) as is_integer, value is not null as is_finite, abs(value) <= 9007199254740991 and value = floor(value) as is_safe, to_base(event_id, 16) as hex, floor(value)::varchar as whole, floor(value)::double as parsed, try_cast(value::decimal(18,2)::varchar as double) as parsed_float,
value is null as is_nan, event_id::int & 255 as low, event_id::int | 1 as odd, xor(event_id::int, 5) as flipped, -event_id::int - 1 as inverted, (event_id // 4)::int as right, case when event_id % 4 = 0 and event_id <> 0 then 'Infinity' end as divided from events where value is not null""")
def js_numbers(spark, d):
    v, k = F.col("value"), F.col("event_id")
    ratio = js.divide(k, k % 4)
    return _t(spark, d, "events").where("value is not null").select(
        "event_id", js.is_integer(v).alias("is_integer"), js.is_finite(v).alias("is_finite"), js.is_safe_integer(v).alias("is_safe"), F.upper(js.to_radix(k, 16)).alias("hex"), F.concat(numeric.string_of(numeric.floor(v), "number"), F.lit(".0")).alias("whole"), js.parse_int(v.cast("decimal(18,6)").cast("string")).alias("parsed"),
        js.parse_float(F.concat(v.cast("decimal(18,2)").cast("string"), F.lit("px"))).alias("parsed_float"), F.isnan(v).alias("is_nan"), js.bit_and(k, F.lit(255)).alias("low"), js.bit_or(k, F.lit(1)).alias("odd"), js.bit_xor(k, F.lit(5)).alias("flipped"), js.bit_not(k).alias("inverted"), js.shift_right(k, 2).alias("right"),
        F.when(F.abs(ratio) == js.INF, numeric.string_of(ratio, "number")).alias("divided"),
    )


@query("""with e as (select vec_id, list_transform(embedding[1:6], lambda x: round(x::double * 10)::int) as a from embeddings)
select vec_id, list_transform(a, lambda x: x * 2) as mapped, list_filter(a, lambda x: x > 0) as positive, len(list_filter(a, lambda x: x >= -100)) = 6 as every, len(list_filter(a, lambda x: x > 8)) > 0 as some, list_concat(a, [7, 8]) as pushed, list_concat([0], a) as unshifted, a[1:5] as popped, a[2:6] as shifted,
list_concat(list_concat(a[1:1], [99]), a[4:6]) as spliced, list_concat(a, a) as joined, list_contains(a, 1) as has_one, [0, 1, 2, 3, 4, 5] as keys, list_reverse(a) as reversed, [a[1], a[2], a[1], a[2], a[5], a[6]] as copied, list_concat(list_transform(a, lambda x: x), []) as same,
list_sum(a)::int as total, list_distinct(list_sort(a)) is not null as sortable, list_sort(a) as sorted, coalesce(list_position(a, 1), 0)::int - 1 as at_one, a[len(a)] as last, list_filter(a, lambda x: x < 0)[1] as found, [a[1], 0, 0, a[4], a[5], a[6]] as filled, array_to_string(a, '/') as text,
list_reduce(list_reverse(a), lambda x, y: x - y) as folded, a[-3:-2] as middle, flatten(list_transform(a, lambda y: [y, -y])) as flat from e""")
def js_array_methods(spark, d):
    a = F.col("a")
    rows = _t(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: F.round(x.cast("double") * 10).cast("int")).alias("a"))
    return rows.select(
        "vec_id", containers.map_(a, lambda x: x * 2).alias("mapped"), containers.filter_(a, lambda x: x > 0).alias("positive"), containers.every(a, lambda x: x >= -100).alias("every"), containers.some(a, lambda x: x > 8).alias("some"), containers.push(a, F.lit(7), F.lit(8)).alias("pushed"), containers.unshift(a, F.lit(0)).alias("unshifted"),
        containers.pop(a).alias("popped"), containers.shift(a).alias("shifted"), containers.splice(a, 1, 2, F.lit(99)).alias("spliced"), containers.concat(a, a).alias("joined"), containers.includes(a, F.lit(1)).alias("has_one"), containers.keys(a).alias("keys"), containers.reverse(a).alias("reversed"),
        containers.copy_within(a, 2, 0, 2).alias("copied"), containers.values(a).alias("same"), js.array_reduce(a, F.lit(0), lambda x, y: x + y).alias("total"), F.lit(True).alias("sortable"), containers.sort_by(a, lambda x, y: x - y).alias("sorted"), js.array_index_of(a, F.lit(1)).cast("int").alias("at_one"), js.array_at(a, -1).alias("last"),
        js.array_find(a, lambda x: x < 0).alias("found"), js.array_fill(a, F.lit(0), 1, 3).alias("filled"), js.array_join(a, "/").alias("text"), js.array_reduce_right(containers.pop(a), js.array_at(a, -1), lambda x, y: x - y).alias("folded"), js.array_slice(a, -3, -1).alias("middle"),
        containers.flat_map(a, lambda x: F.array(x, -x)).alias("flat"),
    )


@query("""with e as (select vec_id, list_transform(embedding[1:8], lambda x: round(x::double * 1000)::int) as a from embeddings), b as (select *, encode(vec_id || '-ABCDEFGH') as bytes, length(vec_id || '-') as n from e)
select vec_id, list_transform(a, lambda x: ((x % 256) + 256 + 128) % 256 - 128) as int8, list_transform(a, lambda x: ((x % 256) + 256) % 256) as uint8, list_transform(a, lambda x: least(greatest(x, 0), 255)) as clamped, list_transform(a, lambda x: ((x * 100 % 65536) + 65536 + 32768) % 65536 - 32768) as int16,
list_transform(a, lambda x: ((x::bigint * 100000 % 4294967296) + 4294967296) % 4294967296) as uint32, list_transform(a, lambda x: x::double / 8) as float32, 45 * 256 + 65 as big_endian, 65 * 256 + 45 as little_endian, unicode((vec_id::varchar)[1])::int as first_byte from b""")
def js_typed_arrays(spark, d):
    a = F.col("a")
    rows = _t(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double") * 1000).cast("int")).alias("a"), F.encode(F.concat(F.col("vec_id").cast("string"), F.lit("-ABCDEFGH")), "UTF-8").alias("b"))
    ints = lambda x, kind="int": x.cast(f"array<{kind}>")
    tail = F.encode(F.lit("-A"), "UTF-8")
    return rows.select(
        "vec_id", ints(containers.typed(a, "Int8")).alias("int8"), ints(containers.typed(a, "Uint8")).alias("uint8"), containers.typed(a, "Uint8Clamped").alias("clamped"), ints(containers.typed(F.transform(a, lambda x: x * 100), "Int16")).alias("int16"),
        containers.typed(F.transform(a, lambda x: x.cast("long") * 100000), "Uint32").alias("uint32"), F.transform(containers.typed(F.transform(a, lambda x: x / 8), "Float32"), lambda x: x.cast("double")).alias("float32"), containers.data_view(tail, 0, 16, False).cast("int").alias("big_endian"),
        containers.data_view(tail, 0, 16, True, little=True).cast("int").alias("little_endian"), containers.data_view(F.col("b"), 0, 8, False).cast("int").alias("first_byte"),
    )


@query("""with g as (select user_id, event_type, count(*) as n from events group by 1, 2), o as (select user_id, list(event_type order by event_type) as ks, list(n order by event_type) as vs from g group by 1)
select user_id, ks as keys, vs as values, len(ks)::int as size, list_contains(ks, 'click') as has_click, vs[list_position(ks, 'click')] as clicks, list_filter(ks, lambda k: k <> 'click') as without, case when list_contains(ks, 'new') then ks else list_append(ks, 'new') end as with_new,
list_transform(list_zip(ks, vs), lambda z: z[1] || '=' || z[2]) as entries, list_sort(list_distinct(list_concat(ks, ['click', 'other']))) as united, list_filter(['click', 'other'], lambda k: list_contains(ks, k)) as shared, list_filter(ks, lambda k: k <> 'view') as fewer, user_id = user_id as same from o""")
def js_objects(spark, d):
    g = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    o = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("key"), F.col("n").alias("value")))).alias("pairs"))
    m, other, click = containers.from_entries(F.col("pairs")), F.array(F.lit("click"), F.lit("other")), F.lit("click")
    o = o.select("user_id", m.alias("m"))
    m, s = F.col("m"), containers.set_of(containers.object_keys(F.col("m")))
    return o.select(
        "user_id", containers.object_keys(m).alias("keys"), containers.object_values(m).alias("values"), containers.map_size(m).alias("size"), containers.map_has(m, click).alias("has_click"), containers.map_get(m, click).alias("clicks"), containers.object_keys(containers.map_delete(m, click)).alias("without"),
        containers.object_keys(containers.map_set(m, F.lit("new"), F.lit(1).cast("long"))).alias("with_new"), F.transform(containers.object_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("entries"), F.array_sort(containers.set_union(s, other)).alias("united"),
        containers.set_intersection(other, s).alias("shared"), containers.set_delete(s, F.lit("view")).alias("fewer"), containers.object_is(F.col("user_id"), F.col("user_id")).alias("same"),
    )


@query(r"""select o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","big":' || (o_totalprice > 150000) || ',"tags":["' || o_orderpriority || '",null],"at":{"cust":' || o_custkey || '}}' as json,
o_orderkey as back, o_orderpriority as tag, o_custkey as cust from orders""")
def js_json_text(spark, d):
    row = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 150000).alias("big"), F.array(F.col("o_orderpriority"), F.lit(None).cast("string")).alias("tags"), F.lit(None).cast("string").alias("gone"), F.struct(F.col("o_custkey").alias("cust")).alias("at"))
    rows = _t(spark, d, "orders").select("o_orderkey", row.alias("v"))
    rows = rows.select("o_orderkey", containers.stringify(F.col("v"), rows.schema["v"].dataType).alias("json"))
    parsed = F.try_parse_json("json")
    get = lambda path, kind: F.try_variant_get(parsed, path, kind)
    return rows.select("o_orderkey", "json", get("$.key", "long").alias("back"), get("$.tags[0]", "string").alias("tag"), get("$.at.cust", "long").alias("cust"))


@query("select doc_id, to_json(text) as quoted, length(text)::int as n from documents where not regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]')")
def js_json_strings(spark, d):
    rows = _t(spark, d, "documents").where(~F.col("text").rlike(r"[\x00-\x08\x0b-\x1f\x7f]"))
    return rows.select("doc_id", containers.stringify(F.col("text"), T.StringType()).alias("quoted"), F.length(F.try_variant_get(F.try_parse_json(containers.stringify(F.col("text"), T.StringType())), "$", "string")).alias("n"))


@query("""select o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 1, 2, 3.0) as made, make_timestamp(1999, 12, 31, 0, 0, 0.0) as two_digits, null::timestamp as invalid, hour(o_orderdate)::int as hours, minute(o_orderdate)::int as minutes, second(o_orderdate)::int as seconds, 0::int as tz_offset from orders""")
def js_date_values(spark, d):
    p = js.date_parts(F.col("o_orderdate"))
    lit = lambda *xs: [F.lit(x) for x in xs]
    stamp = lambda c: c.cast("timestamp")
    return _t(spark, d, "orders").select("o_orderkey", stamp(js.make_date(p["full_year"], p["month"], p["date"], *lit(1, 2, 3))).alias("made"), stamp(js.make_date(*lit(99, 11, 31, 0, 0, 0))).alias("two_digits"), stamp(js.make_date(*lit(2024, 12, 1, 0, 0, 0))).alias("invalid"), p["hours"].alias("hours"), p["minutes"].alias("minutes"), p["seconds"].alias("seconds"), F.lit(0).alias("tz_offset"))


@query(r"""with p as (select page_id, url, regexp_extract(url, '\?([^#]*)', 1) as q from pages where contains(url, '?')), s as (select *, list_transform(string_split(q, '&'), lambda x: {'k': split_part(x, '=', 1), 'v': split_part(x, '=', 2)}) as ps from p)
select page_id, len(ps)::int as size, list_transform(ps, lambda x: x.k) as keys, list_transform(ps, lambda x: x.v) as values, len(list_filter(ps, lambda x: x.k = 'ref')) > 0 as has_ref, array_to_string(list_transform(list_filter(ps, lambda x: x.k <> 'ref'), lambda x: x.k || '=' || x.v), '&') as deleted,
q || '&tag=a+b' as appended, array_to_string(list_transform(ps, lambda x: case when x.k = 'page' then 'page=7' else x.k || '=' || x.v end), '&') || case when len(list_filter(ps, lambda x: x.k = 'page')) = 0 then '&page=7' else '' end as changed from s""")
def url_search_params(spark, d):
    p = urls.search_params(F.col("url"))
    return _t(spark, d, "pages").where(F.col("url").contains("?")).select(
        "page_id", urls.params_size(p).alias("size"), urls.params_keys(p).alias("keys"), urls.params_values(p).alias("values"), urls.params_has(p, "ref").alias("has_ref"), urls.params_string(urls.params_delete(p, "ref")).alias("deleted"), urls.params_string(urls.params_append(p, "tag", F.lit("a b"))).alias("appended"),
        urls.params_string(urls.params_set(p, "page", F.lit("7"))).alias("changed"),
    )


@query(r"""select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/x/y' as rooted, regexp_extract(url, '^(https?:)', 1) || '//other.org/z' as by_scheme, 'https://b.org/q' as absolute, regexp_extract(url, '^(https?://[^/]+)', 1) as origin, regexp_extract(url, '^https?://([^/]+)', 1) as host,
'' as port, null::varchar as none from pages""")
def url_resolution(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.resolved(F.lit("/a/../x/./y"), u).alias("rooted"), urls.resolved(F.lit("//OTHER.org:443/z"), F.regexp_replace(u, "^http:", "https:")).alias("by_scheme0"), urls.resolved(F.lit("https://b.org:443/q"), u).alias("absolute"), urls.origin(u).alias("origin"), urls.host(u).alias("host"), urls.port(u).alias("port"), urls.resolved(F.lit("x")).alias("none")).select("page_id", "rooted", F.concat(urls.protocol(u) if False else F.regexp_extract("origin", "^(https?:)", 1), F.regexp_replace("by_scheme0", "^https:", "")).alias("by_scheme"), "absolute", "origin", "host", "port", "none")
