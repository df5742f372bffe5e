from feedstack.operators.parse import parse_lines
from feedstack.operators.validate import validate_reviews
from helpers import AS_OF, DROP, line, lines_df


def _errors(spark, text):
    df = validate_reviews(parse_lines(lines_df(spark, [text])), AS_OF)
    r = df.select("is_blank", "is_malformed", "errors", "valid").collect()[0]
    return r


def test_valid_line(spark):
    r = _errors(spark, line())
    assert r.valid and r.errors == []


def test_blank_and_malformed(spark):
    assert _errors(spark, "").is_blank
    assert _errors(spark, "   \t ").is_blank
    bad = _errors(spark, '{"hotelId": 1, "comment": {')
    assert bad.is_malformed and not bad.valid


def test_non_object_root_fails_required_rules(spark):
    r = _errors(spark, "123")
    assert r.errors[:3] == ["Hotel ID is required", "Provider is required", "Hotel name is required"]


def test_rule_messages(spark):
    assert _errors(spark, line(hotel_id=-1)).errors == ["Hotel ID must be positive"]
    assert _errors(spark, line(platform="InvalidPlatform")).errors == [
        "Provider must be one of: Agoda, Booking, Expedia"]
    assert _errors(spark, line(platform=" ")).errors == ["Provider cannot be empty"]
    assert _errors(spark, line(name="x" * 256)).errors == ["Hotel name cannot exceed 255 characters"]
    assert _errors(spark, line(rating=15)).errors == ["Rating must be between 0.0 and 10.0"]
    assert _errors(spark, line(rating="abc")).errors == ["Rating must be a valid number"]
    assert _errors(spark, line(rating=True)).errors == ["Rating must be a valid number"]
    assert _errors(spark, line(rating=DROP)).valid  # rating is optional
    assert _errors(spark, line(reviewDate=DROP)).errors == ["Review date is required"]
    assert _errors(spark, line(reviewDate="10/04/2025")).errors == ["Invalid review date format"]
    assert _errors(spark, line(reviewDate="2024-02-30")).errors == ["Invalid review date format"]
    assert _errors(spark, line(reviewDate="2030-01-01T00:00:00")).errors == ["Review date cannot be in the future"]
    assert _errors(spark, line(reviewDate="2001-01-01 00:00:00")).errors == [
        "Review date cannot be older than 20 years"]
    assert _errors(spark, line(reviewDate="2025-01-01")).valid  # date only = midnight
    assert _errors(spark, line(hotelReviewId="12a")).errors == ["Hotel review ID must be a valid number"]
    assert _errors(spark, line(hotelReviewId=" 12")).errors == ["Hotel review ID must be a valid number"]
    assert _errors(spark, line(hotelReviewId=0.5)).errors == ["Hotel review ID must be positive"]
    assert _errors(spark, line(hotelReviewId="77")).valid
    assert _errors(spark, line(reviewComments="y" * 5001)).errors == [
        "Review comments cannot exceed 5000 characters"]
    assert _errors(spark, line(reviewerInfo={"countryName": " "})).errors == [
        "Country name cannot be empty when present"]
    assert _errors(spark, line(reviewerInfo={"lengthOfStay": "abc"})).errors == [
        "Length of stay must be a valid number when present"]
    assert _errors(spark, line(reviewerInfo={"lengthOfStay": 0})).errors == [
        "Length of stay must be positive when present"]
    assert _errors(spark, line(reviewerInfo={"lengthOfStay": "2"})).valid


def test_several_errors_in_rule_order(spark):
    r = _errors(spark, line(hotel_id=0, platform="X", rating=11, reviewDate="bad"))
    assert r.errors == ["Hotel ID must be positive", "Provider must be one of: Agoda, Booking, Expedia",
                        "Rating must be between 0.0 and 10.0", "Invalid review date format"]


def test_lenient_root_int(spark):
    df = parse_lines(lines_df(spark, ['{"hotelId":"12"}', '{"hotelId":"junk"}', '{"hotelId":1.9}',
                                      '{"hotelId":true}', '{"hotelId":null}']))
    assert [r.hotel_id for r in df.orderBy("line_no").collect()] == [12, 0, 1, 1, None]


def test_both_spellings_and_reviewer_name_locations(spark):
    from feedstack.operators.parse import provider_scores
    a = '{"hotelId":1,"overallByProviders":[{"providerId":332,"provider":"Agoda","overallScore":8.1,"reviewCount":3,"grades":{"Room":8.0}},null]}'
    b = '{"hotelId":2,"overallByproviders":[{"providerId":333,"provider":"Booking","overallScore":7.0,"reviewCount":1}]}'
    c = '{"hotelId":3,"comment":{"reviewerDisplayName":" Ann "}}'
    d = '{"hotelId":4,"comment":{"reviewerInfo":{"displayMemberName":"Bo"}}}'
    p = parse_lines(lines_df(spark, [a, b, c, d]))
    scores = sorted((r.score_provider, r.overall_score) for r in provider_scores(p).collect())
    assert scores == [("Agoda", 8.1), ("Booking", 7.0)]
    names = {r.line_no: r.reviewer_name_text for r in p.collect()}
    assert names[3] == " Ann " and names[4] == "Bo"
