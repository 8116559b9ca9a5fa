from evidar.llm import decontam
from tests.llm.data import docs, prose

ITEM = "item_id long, text string"


def found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    return sorted((r["doc_id"], r["item_id"], r["exact"]) for r in decontam.leaks(docs(spark, texts), bench).collect())


def test_units_written_apart(spark):
    """Only units change, and every window holds one."""
    item = "Drive 60 km past the old mill, walk 5 hours to the red barn, carry 3 kg up the steep hill, wait 7 days"
    text = "Drive 60 miles past the old mill, walk 5 minutes to the red barn, carry 3 pounds up the steep hill, wait 7 weeks"
    assert found(spark, [item], [text, item, item.replace(" km", "km"), prose(1, 40)]) == [(0, 0, False), (1, 0, True), (2, 0, True)]


def test_values_that_become_equal(spark):
    item = "Take 3 apples and 5 pears, pay 3 coins, keep 5 plums"
    texts = [item.replace("3", "4").replace("5", "4"), "Take 4 apples and 6 pears, pay 7 coins, keep 8 plums"]
    assert found(spark, [item], texts) == [(0, 0, False)]


def test_unchanged_windows_beside_a_clash(spark):
    copied = "the sum of all the angles in any plain triangle is equal to two right ones"
    item = f"In 3 towns {copied}, says 3 of them"
    clash = f"In 4 towns {copied}, says 7 of them"
    assert found(spark, [item], [clash, "In 4 towns of all says 7 of them"]) == [(0, 0, True)]


def test_items_without_a_window_of_plain_words(spark):
    items = ["Compute 12 + 34 * 56 - 78", "Name the capital", "小明有三个苹果和五个梨他一共有几个水果", "!"]
    texts = ["x compute 12 + 34 * 56 - 78 y", "compute 12 + 34 * 56 - 79", "then name the capital of it", "name a capital", "他问小明有三个苹果和五个梨他一共有几个水果呢", "小明有三个苹果"]
    assert found(spark, items, texts) == [(0, 0, True), (2, 1, True), (4, 2, True)]


def test_names_at_the_begin_of_sentences_and_lines(spark):
    item = "Anna buys 5 pens. Ben sells 3 cups. Carl buys 2 pens. Dora wants 4 hats."
    other = item.replace("Anna", "Maria").replace("Ben", "Otto").replace("Carl", "Eva").replace("Dora", "Ida")
    wrapped = "we asked the old man Anton about the long road to the sea"
    texts = [other, item, wrapped.replace(" Anton", "\nBerta"), wrapped.replace(" Anton", "  Anton"), "Dora sells 5 pens. Ben buys 3 cups. Carl wants 2 hats."]
    assert found(spark, [item, wrapped], texts) == [(0, 0, False), (1, 0, True), (2, 1, False), (3, 1, True)]
