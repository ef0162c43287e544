"""Small hand-made catalog rows."""

import datetime as dt


def catalog_rows(n):
    types = ("image", "video", "audio")
    return [
        {
            "id": i,
            "name": f"f{i}",
            "added_at": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i % 5),
            "description": ["", "a cat", "dogs run"][i % 3],
            "ftype": types[i % 3],
            "is_transcript_analyzed": i % 3 != 0,
            "transcript": [None, "t1", "spoken words"][i % 3],
            "is_transcript_fixed": False,
            "is_ocr_analyzed": i % 3 == 0,
            "is_screenshot": i % 2 == 0 and i % 3 == 0,
            "ocr_text": "o2" if i % 6 == 0 else None,
            "is_llm_description_analyzed": False,
            "llm_description": None,
            "embedding_generation_failed": False,
        }
        for i in range(n)
    ]
