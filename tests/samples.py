"""Invented pages, schemas and candidates: a register of ferry operators."""

from recordlake import RecordSpec

SPEC = RecordSpec.of(
    [
        ("Company Name", "string", True),
        ("email", "email", True),
        ("homepage", "url"),
        ("vessels", "integer"),
        ("fare", "number"),
        ("carries_cars", "boolean"),
        ("last_survey", "date"),
        ("ports", "array"),
    ]
)
LEAD_SPEC = RecordSpec.of([("Company Name", "string", True), ("email", "email", True), ("website", "url")])

# Another order of columns than the schema's, a repeated operator, one without an address.
DIRECTORY = """<html lang="en"><head><title>Ferry register</title></head><body>
<header>Register home</header>
<h2>Operators on the northern lakes</h2><p>As filed with the harbour office, fares in crowns.</p>
<table>
<tr><th>vessels</th><th>Company Name</th><th>ports</th><th>last_survey</th><th>carries_cars</th><th>fare</th><th>email</th><th>homepage</th></tr>
<tr><td>4</td><td>Lumen Crossing</td><td>Aske; Brund</td><td>14 Mar 2016</td><td>no</td><td>12.50</td><td>desk@lumencrossing.no</td><td>https://lumencrossing.no</td></tr>
<tr><td>2</td><td>Grebe Line</td><td>Tvern</td><td>2022-11-30</td><td>yes</td><td>1,040</td><td>office@grebeline.fi</td><td>https://grebeline.fi</td></tr>
<tr><td>9</td><td>Ottervik Cables</td><td></td><td>2011</td><td>yes</td><td>0</td><td></td><td>https://ottervik.test</td></tr>
<tr><td>4</td><td>LUMEN CROSSING</td><td>Aske</td><td></td><td>no</td><td>13</td><td>Desk@LumenCrossing.no</td><td>https://www.lumencrossing.no/fares</td></tr>
<tr><td>1</td><td>Skerry Rowers</td><td>Aske, Ilm, Orn</td><td>3 Jun 2024</td><td>false</td><td>3</td><td>row@skerry.coop</td><td>https://skerry.coop</td></tr>
</table><footer>harbour office</footer></body></html>"""

# A page about one operator whose facts are a list with bold keys, the colon inside.
PROFILE = """<html><body><main><h1>Kelda Pontoons</h1><p>Runs the pontoon at Ilm since the bridge fell.</p>
<ul><li><b>Email:</b> quay@keldapontoons.is</li><li><b>Homepage:</b> https://keldapontoons.is</li>
<li><b>Vessels:</b> 3</li></ul></main></body></html>"""


def page_frame(spark, rows):
    """Rows of (job, rank, url, html)."""
    return spark.createDataFrame(rows, "job_id string, page_rank int, url string, html string")


def candidate_frame(spark, rows, spec):
    """Rows of (job, url, rank, dict)."""
    from recordlake.operators.extract import candidates_from_maps

    frame = spark.createDataFrame(
        [(job, url, rank, 0, raw) for job, url, rank, raw in rows],
        "job_id string, url string, page_rank int, cand_idx int, raw map<string,string>",
    )
    return candidates_from_maps(frame, spec)
