"""Codec, parser, arithmetic, integrity and geometry: golden values, round trips and laws."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from lodestone.functions import arith, codec, geometry, integrity, parse, tokens as T
from lodestone.session import ship
from pyspark.sql import functions as F

INTEGERS = {
    0: ("0780", 6), 1: ("0f80", 6), -1: ("8f80", 6), 42: ("20bc", 1), 123: ("0887e0", 4), -123: ("8ca7e0", 4), -105: ("882be0", 4),
    2147483647: ("104872206621fc", 1), -2147483648: ("94697a6276a63c", 1), 12345678901234567890: ("08864298e848022190a63a120f00", 7), 10**30: ("080000000000000000000000000000000000001e", 0),
}
WORDS = {
    "A": "f83c", "HI": "f9d1e0", "HELLO": "f9c8b5bbc0", "hello": "ffce45addef0", "aB": "ffc1e0f8", "HelloWorld": "f9fe45addeb7dd158fde", "test@example.com": "ffe6494f44b818f593dbf89ccf78",
    "a.b-c": "ffc1edfc3b17bc", "a!b": "ffc1f0783ef0", "(x)": "fffe7f5fe8f7bc", "key=val": "ffd44c7e1ea817ef00", "{x}": "ffff9f5ffbf7bc", "user 42": "ffe92247daf13fe17fc0", "id007": "ffd03f781ff03fe3ffc0",
}
ALPHABET = T.UPPER + T.LOWER + T.PUNCTUATION + T.DIGITS


def one(spark, *columns):
    ship(spark)
    return spark.range(1).select(*columns).first()


def test_integers(spark):
    rows = spark.createDataFrame([(str(v),) for v in INTEGERS], "s string").withColumn("v", F.col("s").cast("decimal(38,0)"))
    codes = codec.encode_integer(F.col("v"))
    for r in rows.select("s", codec.pack_hex(codes).alias("h"), codec.pad_bits(codes).alias("p"), codec.unpack(codec.pack(codes), codec.pad_bits(codes)).alias("u"), codes.alias("c")).collect():
        assert (r["h"], r["p"]) == INTEGERS[int(r["s"])] and r["u"] == r["c"]
        assert parse.parse(r["c"]) == [("number", None, int(r["s"]), None)]


def test_words(spark):
    ship(spark)
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").withColumn("c", codec.encode_word(F.col("w")))
    for r in rows.select("w", codec.pack_hex(F.col("c")).alias("h"), parse.text_of(parse.parsed("c")).alias("back")).collect():
        assert r["h"] == WORDS[r["w"]] and r["back"] == r["w"]


def test_random_words_round_trip(spark):
    ship(spark)
    rng = random.Random(0)
    words = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").withColumn("c", codec.encode_word(F.col("w")))
    assert all(r["w"] == r["back"] for r in rows.select("w", parse.text_of(parse.parsed("c")).alias("back")).collect())


def test_characters_outside_the_alphabets(spark):
    rows = spark.createDataFrame([("HI~",), ("é",), ("a\nb",), (None,)], "w string")
    assert [r[0] for r in rows.select(codec.encode_word(F.col("w"), strict=False)).collect()] == [None] * 4
    with pytest.raises(Exception, match="cannot be encoded"):
        rows.select(codec.encode_word(F.col("w"))).collect()


def test_bit_strings(spark):
    got = one(
        spark,
        codec.bits(codec.encode_integer(F.lit(-123)), " "),
        codec.bits(codec.encode_expression(2, "+", -3), " "),
        codec.bits(codec.encode_expression(-123, "S", 2), " "),
        codec.bits(F.concat(codec.encode_record(F.lit(1)), codec.encode_record(F.lit(2))), " "),
        codec.pack_hex(codec.encode_record(F.lit(1), F.lit(2))),
        codec.bits(codec.encode_digits(F.array(F.lit(1), F.lit(-2))), " "),
    )
    assert list(got) == [
        "10001 10010 10011 11110", "00010 11110 01010 10011 11110", "10001 10010 10011 11110 11011 00010 11110",
        "00001 11110 11100 00010 11110 11100", "0f85ee00", "00001 10010 11110",
    ]


def test_offsets(spark):
    codes = codec.encode_record(F.lit(1), F.lit(2))
    assert one(spark, codec.read_at(codes, F.lit(10), F.lit(2)))[0] == [2, 30]
    with pytest.raises(Exception, match="inside a token"):
        one(spark, codec.read_at(codes, F.lit(3), F.lit(2)))


def test_bytes_and_commands(spark):
    got = one(spark, codec.encode_bytes(F.lit(b"\x00\xff\x07")), codec.encode_command("AUTH", F.lit(42)), F.concat(codec.encode_command("AUTH", F.lit(42)), codec.encode_integer(F.lit(7))))
    assert [v for _, _, v, _ in parse.parse(got[0])] == [0, 255, 7]
    assert parse.parse(got[1]) == [("command", None, None, "AUTH"), ("number", None, 42, None)]
    assert [p[2] for p in parse.parse(got[2])] == [None, 42, 7]
    assert one(spark, codec.encode_bytes(F.lit(b"")))[0] == []


def test_adjacent_words_merge_unless_a_number_stands_between(spark):
    word = lambda w: codec.encode_word(F.lit(w))
    got = one(spark, F.concat(word("ACME"), word("CORP")), F.concat(word("ACME"), codec.encode_integer(F.lit(0)), word("CORP")))
    assert parse.parse(got[0]) == [("word", "ACMECORP", None, None)]
    assert [p[0] for p in parse.parse(got[1])] == ["word", "number", "word"]


def test_labels_in_both_layouts(spark):
    label = lambda at, n: codec.encode_label(F.lit(at), F.lit(n))
    number, word = lambda v: codec.encode_integer(F.lit(v)), lambda w: codec.encode_word(F.lit(w))
    got = one(
        spark,
        F.concat(label(0, "age"), number(25), label(1, "balance"), number(5000), label(2, "name"), word("Alice")),
        F.concat(label(0, "age"), label(1, "balance"), label(2, "name"), number(25), number(5000), word("Alice")),
    )
    want = {"age": "25", "balance": "5000", "name": "Alice"}
    assert parse.by_labels(parse.parse(got[0])) == parse.by_labels(parse.parse(got[1])) == want


def test_parser_details():
    assert parse.parse([1, 18]) == [("number", None, 8, None)]  # mixed signs
    assert parse.parse([2, 10, 3]) == [("number", None, 2, None), ("operator", None, None, "+"), ("number", None, 3, None)]
    assert parse.parse([31, 7, 28, 5]) == [("word", "H", None, None), ("record", None, None, None), ("number", None, 5, None)]
    assert parse.parse([5, 29, 28, 6]) == [("number", None, 5, None), ("number", None, 6, None)]  # the payload 28 ends no record
    with pytest.raises(ValueError):
        parse.parse([31, 31, 31, 31, 9])
    assert parse.resolve_scales(parse.parse([1, 2, 30, 27, 1])) == [("scaled", None, 12, "1")]
    with pytest.raises(ValueError):
        parse.resolve_scales(parse.parse([1, 30, 27, 17]))
    assert parse.all_text([("word", "a", None, None), ("number", None, 7, None), ("record", None, None, None)]) == "a7"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 31), max_size=60))
def test_packing_in_python(codes):
    number = int("".join(f"{c:05b}" for c in codes) or "0", 2)
    pad = -5 * len(codes) % 8
    raw = (number << pad).to_bytes((5 * len(codes) + 7) // 8, "big")
    assert parse.unpack_bytes(raw, pad) == codes


def test_long_blobs():
    raw = bytes(random.Random(1).randbytes(20_001))
    bits = "".join(f"{b:08b}" for b in raw)
    assert parse.unpack_bytes(raw) == [int(bits[i : i + 5], 2) for i in range(0, len(bits) - 4, 5)]


def test_splitting():
    assert [(i, o, t) for i, o, t in parse.split_records([1, 30, 28, 29, 28, 2, 28, 5])] == [(0, 0, [1, 30, 28]), (1, 15, [29, 28, 2, 28])]


EXPRESSIONS = [([2, "+", 3, "=", 5], 1), ([-123, "*", -8175], 1005525), ([2, "+", 3, "*", 4], 14), (["(", 2, "+", 3, ")", "*", 4], 20), ([2, "^", 3, "^", 2], 512), ([-7, "/", 2], -4), ([7, "/", -2], -4), ([-7, "/", -2], 3), ([1, "=", 1, "=", 1], 1), ([], 0), ([10, "-", 3, "-", 2], 5)]


@pytest.mark.parametrize("items,value", EXPRESSIONS)
def test_expressions(spark, items, value):
    assert arith.evaluate(items) == value
    assert one(spark, arith.expression(items))[0] == value


def test_expression_errors(spark):
    for items in (["(", 1], [1, ")"], [1, "+"], [1, 2], [1, "?", 2]):
        with pytest.raises(ValueError):
            arith.evaluate(items)
        with pytest.raises(ValueError):
            arith.expression(items)
    with pytest.raises(ZeroDivisionError):
        arith.evaluate([1, "/", 0])
    with pytest.raises(Exception, match="division by zero"):
        one(spark, arith.expression([1, "/", 0]))
    with pytest.raises(Exception, match="negative exponent"):
        one(spark, arith.expression([2, "^", -1]))
    assert arith.evaluate([10, "^", 30]) == 10**30


def test_decimals(spark):
    s = lambda n, k: arith.scaled(F.lit(n), F.lit(k))
    got = one(spark, arith.add(s(-1234, 3), s(5678, 3)), arith.add(s(1, 1), s(2, 2)), arith.subtract(s(1, 0), s(25, 2)), arith.multiply(s(12, 1), s(-3, 2)), arith.from_double(F.lit(-1.25)), arith.from_double(F.lit(3.0)), arith.as_double(s(125, 2)))
    assert [(int(r[0]), r[1]) for r in got[:6]] == [(4444, 3), (12, 2), (75, 2), (-36, 3), (-125, 2), (3, 0)] and got[6] == 1.25
    with pytest.raises(Exception, match="negative scale"):
        one(spark, s(1, -1))


def test_checksums(spark):
    codes = codec.encode_record(F.lit(12), F.lit(-7))
    got = one(spark, codes, integrity.checksum(codes), integrity.append_checksum(codes), integrity.verify_checksum(codes, F.lit(99)), integrity.next_sync_point(codes), integrity.next_sync_point(codec.encode_integer(F.lit(1))), integrity.flip_bit(codes, 0, 4))
    assert got[1] == sum(got[0]) % 32 and got[2] == [*got[0], 29, got[1]] and not got[3]["passed"] and got[4] == len(got[0]) - 1 and got[5] is None
    assert got[6][0] == got[0][0] ^ 1 and got[6][1:] == got[0][1:]


def test_scanning_for_damage(spark):
    parse.register(spark)
    scan = lambda t: [tuple(r) for r in spark.sql(f"select * from scan_checksums(array({', '.join(map(str, t))}))").collect()]
    assert scan([1, 30, 29, 31, 2, 29, 2]) == [(0, 31, 31, True), (1, 2, 2, True)]
    assert scan([1, 30, 29, 29, 2, 29, 2]) == [(0, 29, 31, False), (1, 2, 2, True)]  # a payload may look like a control
    assert scan([1, 29]) == [(0, -1, 1, False)]
    assert [r["text"] for r in spark.sql("select * from parse_tokens(array(31, 7, 8, 30))").collect()] == ["HI"]


def test_hashes(spark):
    import hashlib

    got = one(spark, integrity.hash_bucket(F.lit("alice@example.com"), 64), integrity.hash_id(F.lit("t"), 999_999), integrity.content_hash(codec.encode_word(F.lit("HI"))))
    h = lambda s: hashlib.sha256(s)
    assert got[0] == int.from_bytes(h(b"alice@example.com").digest()[:8], "big") % 64 and got[1] == int(h(b"t").hexdigest()[:8], 16) % 999_999
    assert got[2] == h(bytes.fromhex("f9d1e0")).hexdigest()[:16]


def test_distances(spark):
    v = geometry.vector
    got = one(spark, geometry.hamming(F.lit(0xABCD), F.lit(0xABCE)), geometry.manhattan(v([1, 2, 3]), v([1, 2])), geometry.manhattan(v([]), v([])), geometry.manhattan(v([1, 2, 3]), v([4])))
    assert list(got) == [2, 3, 0, 8]
    rows = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 3, 4), (2, 10, 20, 30), (3, 0, 1, 2)], "id int, a int, b int, c int")
    assert [r["id"] for r in rows.where(geometry.within(["a", "b", "c"], [1, 2, 3], 10)).collect()] == [0, 1, 3]
    five = spark.createDataFrame([(5, 0)], "a int, b int")
    assert five.where(geometry.within(["a", "b"], [0, 0], 5)).count() == 0 and five.where(geometry.within(["a", "b"], [0, 0], 6)).count() == 1


def test_metric_laws(spark):
    rng = random.Random(2)
    rows = [tuple([rng.randint(-9, 9) for _ in range(rng.randint(0, 5))] for _ in range(3)) for _ in range(100)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, c array<bigint>")
    m = lambda x, y: geometry.manhattan(F.col(x), F.col(y))
    for r in df.select(m("a", "b").alias("ab"), m("b", "a").alias("ba"), m("b", "c").alias("bc"), m("a", "c").alias("ac"), m("a", "a").alias("aa")).collect():
        assert r["ab"] == r["ba"] >= 0 == r["aa"] and r["ac"] <= r["ab"] + r["bc"]


def streams(seed, n=400):
    """Random streams that parse() reads: all codes, deep nesting, runs of checksums, long numbers."""
    rng, out = random.Random(seed), [[], [30, 30, 5], [29], [29, 29], [29, 29, 29, 28], [31] * 7 + [0] + [30] * 4 + [3, 30, 28], [9] * 38 + [30], [25] * 19 + [30, 1]]
    while len(out) < n:
        kinds = rng.choice([range(32), (28, 29, 30, 31, 1, 2, 17), (30, 31, 0, 5), (29, 28, 3), tuple(range(26)) + (30,) * 6 + (31,) * 4])
        codes = [rng.choice(kinds) for _ in range(rng.randint(0, 40))]
        try:
            if all(v is None or abs(v) < 10**38 for _, _, v, _ in parse.parse(codes)):
                out.append(codes)
        except ValueError:
            pass
    return out


def test_batches_are_read_like_single_streams(spark):
    ship(spark)
    given = streams(11)
    first = np.concatenate([[0], np.cumsum([len(c) for c in given])])
    begin, values = parse.read_streams(np.array([x for c in given for x in c], np.int64), first)
    flat = [(v["kind"], v["text"], None if v["value"] is None else int(v["value"]), v["symbol"]) for v in values.to_pylist()]
    for i, c in enumerate(given):
        assert flat[begin[i] : begin[i + 1]] == parse.parse(c), c
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(given)] + [(-1, None)], "i int, c array<int>").repartition(3)
    for r in rows.select("i", "c", parse.parsed("c").alias("p")).collect():
        assert (r["p"] is None) if r["i"] < 0 else [(x["kind"], x["text"], None if x["value"] is None else int(x["value"]), x["symbol"]) for x in r["p"]] == parse.parse(r["c"])
    for bad in ([31, 31, 31, 31, 9], [32], [-1]):
        with pytest.raises(ValueError):
            parse.read_streams(np.array(bad), np.array([0, len(bad)]))


def test_records_and_checksums_of_batches(spark):
    parse.register(spark)
    given = streams(12)
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(given)], "path string, tokens array<int>").repartition(3)
    got = sorted((int(r["path"]), r["record_idx"], r["bit_offset"], r["tokens"]) for r in parse.records_of(rows).collect())
    assert got == [(i, *r) for i, c in enumerate(given) for r in parse.split_records(c)]
    rows.createOrReplaceTempView("given_streams")
    one_by_one = spark.sql("select path, s.* from given_streams, lateral scan_checksums(tokens) s")
    assert sorted(map(tuple, parse.checksums_of(rows).collect())) == sorted(map(tuple, one_by_one.collect())) != []


def test_packing_of_any_codes(spark):
    given = [c for c in streams(13, 200)] + [[i % 32 for i in range(n)] for n in range(20)]
    rows = spark.createDataFrame([(c,) for c in given] + [(None,)], "c array<int>").withColumn("b", codec.pack(F.col("c")))
    for r in rows.select("c", "b", codec.unpack(F.col("b"), codec.pad_bits(F.col("c"))).alias("u"), codec.unpack(F.col("b"), 0, F.lit(3)).alias("three")).collect():
        if r["c"] is None:
            assert r["b"] is r["u"] is None
            continue
        number, pad = int("".join(f"{c:05b}" for c in r["c"]) or "0", 2), -5 * len(r["c"]) % 8
        assert bytes(r["b"]) == (number << pad).to_bytes((5 * len(r["c"]) + 7) // 8, "big") and r["u"] == r["c"] and r["three"][: len(r["c"])] == r["c"][:3]


def test_encoders_need_no_alias(spark):
    ship(spark)
    word = codec.encode_word(F.lit("Ann"))
    assert [p["text"] for p in one(spark, parse.parsed(word))[0]] == ["Ann"]
    assert one(spark, parse.evaluated(codec.encode_expression(2, "+", 3)))[0] == "5"
    assert one(spark, parse.labelled(F.concat(codec.encode_label(F.lit(0), F.lit("a")), word)))[0] == {"a": "Ann"}


POWERS = [(3, 35), (3, 39), (-7, 20), (0, 0), (0, 500), (1, 10**6), (-1, 10**6 + 1), (2, 62), (-2, 63), (10, 18)]


def test_exact_arithmetic(spark):
    rows = spark.createDataFrame(POWERS, "a bigint, b bigint")
    for r in rows.select("a", "b", arith.expression([F.col("a"), "^", F.col("b")]).alias("v")).collect():
        assert r["v"] == r["a"] ** r["b"]
    wide = one(spark, arith.expression([10**30, "+", 1]), arith.expression([3, "^", 79], wide=True), arith.expression([-(10**31) - 1, "/", 10]), arith.expression([12345678901234567890, "*", 10**18]))
    assert [int(v) for v in wide] == [10**30 + 1, 3**79, (-(10**31) - 1) // 10, 12345678901234567890 * 10**18]
    for items, more in (([3, "^", 41], False), ([2**62, "+", 2**62], False), ([2, "^", 200], True), ([10**37, "*", 11], False), ([-(2**63), "-", 1], False)):
        with pytest.raises(Exception, match="too large"):
            one(spark, arith.expression(items, wide=more))
    assert rows.select(arith.expression([F.lit(None).cast("bigint"), "+", F.col("a")])).first()[0] is None
    assert one(spark, arith.power(F.lit(3), F.lit(35)))[0] == 3**35
    with pytest.raises(Exception, match="too large"):
        one(spark, arith.power(F.lit(3), F.lit(41)))


def test_scales_are_annotations_in_streams(spark):
    ship(spark)
    got = one(spark, *[parse.evaluated(codec.encode_expression(*e)) for e in ([-123, "S", 2], [5, "S", 2, "+", 7, "S", 1], ["(", 5, "S", 2, "+", 1, ")", "*", 4])])
    assert list(got) == ["-123", "12", "24"]
    with pytest.raises(Exception, match="negative scale"):
        one(spark, parse.evaluated(codec.encode_expression(5, "S", -2)))
