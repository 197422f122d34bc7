from folioscan.operators import frontpage

VENUE_LINE = ["Slow mapping of river sediments with acoustic sensors and small networks", "SCIENCE COMMUNICATIONS | (2021) 3:118 | https://doi.org/10.9999/abc-021-5", "Anna Bergmann 1,2*, Luca Moretti3, Priya Natarajan 4,5*", "Abstract", "We describe a data set of river sediments."]
PRESS = ["Article in Press", "Robust counting of migrating birds from micro\u0080uidic radar signatures", "Anna Bergmann, Luca Moretti, Tomas Vrana, Jane Q. Miller & Wei Chen", "Nature Communications", "Received: 3 May 2022 Accepted: 9 July 2023", "Abstract", "We present a counting pipeline."]
EDITOR = ["Automatic grading of glacier photographs by transfer learning and voting over weather stations", "Anna Bergmann a,b,* , Luca Moretti a , Tomas Vrana c", "A R T I C L E I N F O", "Handling Editor: P. Doe", "A B S T R A C T", "Glaciers shrink, and their photographs are many.", "Talanta 201 (2023) 120001"]


def test_venue_header_is_not_the_authors():
    title, year, authors, venue, _, language = frontpage.metadata("\n".join(VENUE_LINE), "Bergmann - 2021 - Slow.pdf")
    assert title == VENUE_LINE[0] and year == "2021" and venue == "SCIENCE" and language == "en"
    assert authors.startswith("Anna Bergmann") and "SCIENCE" not in authors and "\\" not in authors


def test_long_list_before_a_venue_line():
    title, year, authors, *_ = frontpage.metadata("\n".join(PRESS), "Bergmann - 2023 - Robust.pdf")
    assert "microfluidic" in title and year == "2023" and "Anna Bergmann" in authors and "Wei Chen" in authors


def test_editor_lines_are_skipped():
    title, year, *_ = frontpage.metadata("\n".join(EDITOR), "x.pdf")
    assert title == EDITOR[0] and year == "2023"


def test_first_page_only(spark):
    rows = [("d", "Moretti - 2015 - Wide.pdf", 0, 0, "Wide Channel Pooling for Leaf Recognition"), ("d", "Moretti - 2015 - Wide.pdf", 1, 0, "Luca Moretti Anna Bergmann Tomas Vrana Wei Chen"), ("d", "Moretti - 2015 - Wide.pdf", 2, 0, "Abstract Wider pools of leaves are harder to tell apart."), ("d", "Moretti - 2015 - Wide.pdf", 3, 1, "Proceedings of the 9th Annual Meeting of the ACL 2016.")]
    got = frontpage.front_pages(spark.createDataFrame(rows, "doc_id string, file_name string, ord long, page long, text string")).first()
    assert (got.title, got.authors, got.venue, got.year) == (rows[0][4], rows[1][4], "", "2015")


def test_nothing():
    assert frontpage.metadata(None, None) == ("", "", "", "", "", "unknown")
