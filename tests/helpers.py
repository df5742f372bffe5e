import json

AS_OF = "2025-06-01 00:00:00"


def line(hotel_id=101, platform="Agoda", name="Hotel One", **comment):
    c = {"hotelReviewId": 1001, "rating": 8.5, "reviewDate": "2025-04-10T05:37:00+07:00",
         "reviewComments": "Nice stay", "reviewerInfo": {"countryName": "Thailand", "lengthOfStay": 2}}
    c.update(comment)
    c = {k: v for k, v in c.items() if v is not _DROP}
    obj = {"hotelId": hotel_id, "platform": platform, "hotelName": name, "comment": c}
    obj = {k: v for k, v in obj.items() if v is not _DROP}
    return json.dumps(obj)


class _Drop:
    pass


_DROP = _Drop()
DROP = _DROP


def lines_df(spark, lines, file_key="f1.jl"):
    rows = [(file_key, i + 1, text) for i, text in enumerate(lines)]
    return spark.createDataFrame(rows, "file_key string, line_no int, line string")
