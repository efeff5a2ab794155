"""The published examples of Porter's algorithm, and scores over stems."""

from pyspark.sql import functions as F

from strataline.functions import metrics as M
from strataline.functions.stem import porter, token_stem, with_stems

#: Word and stem, from the description of the algorithm (with the usual extensions).
EXAMPLES = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil
dies die dying die lying lie news news yttrium yttrium spied spi tied tie""".split()


def test_published_examples():
    assert {w: porter(w) for w in EXAMPLES[::2]} == dict(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True))
    assert token_stem("dies") == "die" and token_stem("was") == "was" and porter("was") == "wa" and porter("") == ""


def test_each_distinct_token_is_stemmed_once(spark):
    df = spark.createDataFrame([(1, "running"), (2, "running"), (3, "runs"), (4, None), (5, "")], "id int, t string")
    assert {r.id: r.stem for r in with_stems(df, "t").collect()} == {1: "run", 2: "run", 3: "run", 4: None, 5: ""}


def test_scores_over_stems(spark):
    pairs = spark.createDataFrame([(1, "The nurses were holding drills.", "the nurse was hold the drill"), (2, "", "x")], "k int, a string, b string")
    got = {r.k: r for r in pairs.select("k", M.text_scores(F.col("a"), F.col("b"), token_stem).alias("s")).select("k", "s.*").collect()}
    assert got[1].rouge1 == 2 * 4 / 11 and got[1].rougeL == 2 * 4 / 11 and got[2].rouge1 == 0
    assert {r.k: r.rouge1 for r in M.rouge1_table(pairs, "k", "a", "b", stemmed=True).collect()} == {1: 2 * 4 / 11, 2: 0}
    preds = spark.createDataFrame([("i", "nurse holds saws", "", "")], "id string, pred_l0 string, pred_l1 string, pred_l2 string")
    truth = spark.createDataFrame([("i", "nurses holding saw", "", "", 1)], "id string, gt_l0 string, gt_l1 string, gt_l2 string, ord int")
    value = {(r.level, r.metric): r.value for r in M.evaluate(preds, truth).collect()}
    assert value["l0", "rougeL"] == value["l0", "rouge1"] == 1.0
    assert {(r.level, r.metric): r.value for r in M.evaluate(preds, truth, stem=None).collect()}["l0", "rouge1"] == 0
