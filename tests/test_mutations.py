from cotejo.spec.layout import Field, Layout, Record, Rule
from cotejo.spec.mutations import detection
from cotejo.spec.synthesis import synthesise
from cotejo.spec.writers import render_lines

LAYOUT = Layout(
    "m", "fixed",
    (
        Record("01", fields=(Field("kind", "constant", 1, 2, constant="01"), Field("day", "date", 3, 8, date_mask="AAAAMMDD")), place="first"),
        Record("02", fields=(Field("kind", "constant", 1, 2, constant="02"), Field("n", "integer", 3, 8)), most=None),
        Record("09", fields=(Field("kind", "constant", 1, 2, constant="09"), Field("sum", "integer", 3, 8)), place="last"),
    ),
    (Rule("R1", 'valor("09", "sum") == sumar("02", "n")', "file"),), line_length=10,
)


def test_every_fault_is_found_and_nothing_else(spark):
    lines = render_lines(synthesise(spark, LAYOUT, 3), LAYOUT).select("line", "code", "value").cache()
    found = {r.mutation: r.found for r in detection(lines, LAYOUT, spark).collect()}
    assert found.pop("none") == 0 and len(found) == 12 and all(found.values())
