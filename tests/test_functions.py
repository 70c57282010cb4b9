import pytest
from pyspark.sql import functions as F

from keyloom.functions import hashing, text

CLEANED = {
    "The Godfather": "godfather",
    "Lord of the Rings": "lord rings",
    "x a a y": "x a y",
    "the": "the",
    "of the the of": "the",
    "José  Peña-Nieto": "jos pea nieto",
    "1.5": "1 5",
    "O'Neil d'Or": "o neil",
    "al_bunda": "al bunda",
    "---": "",
    "Unknown": "unknown",
}

CHARFEAT = {
    "": ([37], [111], 0, 140737488355328),
    "a": ([12, 38], [39, 112], 549755813888, 281474976710656),
    "usa": ([15, 33, 35, 40], [1, 53, 106, 114], 9007199254740994, 1130297953353728),
    "germany": ([20, 24, 26, 32, 33, 44], [4, 8, 79, 90, 96, 118], 272, 18014402871590912),
    "muhammad lee": ([1, 10, 16, 30, 34, 49], [10, 21, 35, 60, 79, 123], 1152921538968683520, 576460752303456256),
    "james cameron": ([0, 4, 5, 17, 30, 50], [13, 33, 47, 50, 85, 124], 1266645985140736, 1152921504608944128),
    "0 49 1": ([8, 9, 10, 13, 18, 43], [40, 42, 47, 54, 70, 117], 18160633555976192, 9007199254741056),
    "al_bunda": ([22, 24, 32, 34, 45], [7, 14, 89, 96, 119], 16512, 36028801347485696),
    "üben": ([17, 20, 29, 41], [62, 72, 100, 115], 4611686018427387904, 2251868533162240),
}


def tokens(spark, values):
    return spark.createDataFrame([(v,) for v in values], "token string")


def test_cleaning(spark):
    got = dict(tokens(spark, CLEANED).select("token", text.clean_text(F.col("token")).alias("c")).collect())
    assert got == CLEANED


def test_charfeat_positions_and_lanes(spark):
    df = tokens(spark, CHARFEAT).select("token", hashing.charfeat_positions(F.col("token"), 64).alias("a"), hashing.charfeat_positions(F.col("token"), 128).alias("b"))
    df = hashing.family("charfeat").attach(df, "token")
    got = {r["token"]: (r["a"], r["b"], r["sk0"], r["sk1"]) for r in df.collect()}
    assert got == CHARFEAT


def test_charfeat_sizes_and_ones(spark):
    g = tokens(spark, ["germany"])
    pos = lambda **k: g.select(hashing.charfeat_positions(F.col("token"), **k)).first()[0]
    assert pos(bits=256) == [114, 135, 147, 185, 193, 229]
    assert pos(bits=512) == [258, 304, 329, 412, 429, 488]
    assert pos(bits=128, ones=6) == [4, 8, 18, 79, 90, 96, 118]


def test_murmur_vectors():
    assert hashing.murmur3_32(b"hello") == 0x248BFA47
    assert hashing.murmur3_32(b"") == 0
    assert hashing.murmur3_128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert hashing.murmur3_128(b"") == (0, 0)


@pytest.mark.parametrize("name", ["charfeat", "bloom", "bloom_murmur", "md5", "simhash", "xx", "murmur"])
@pytest.mark.parametrize("bits", [64, 128, 256])
def test_families_are_stable_and_sized(spark, name, bits):
    fam = hashing.family(name, bits)
    rows = fam.attach(tokens(spark, ["usa", "usa", "germany", ""]), "token").collect()
    assert len(fam.columns) == bits // 64 and rows[0] == rows[1]
    assert all(r[c] is not None for r in rows for c in fam.columns)


def test_unknown_family_and_size(spark):
    with pytest.raises(ValueError):
        hashing.family("city").attach(tokens(spark, ["a"]), "token")
    with pytest.raises(ValueError):
        hashing.family("charfeat", 100).attach(tokens(spark, ["a"]), "token")


def test_bloom_sizing():
    assert hashing.bloom_size(1000, 0.01) == 9585
    assert hashing.bloom_hashes(128, 6) == 14


def test_split_and_shingles(spark):
    df = spark.createDataFrame([("a, b,c", "ab"), ("", "a-bcd e")], "s string, t string")
    rows = df.select(text.split_list(F.col("s")).alias("s"), text.shingles(F.col("t")).alias("t")).collect()
    assert [r["s"] for r in rows] == [["a", "b,c"], [""]]
    assert [r["t"] for r in rows] == [["ab"], ["abc", "bcd", "cde"]]
