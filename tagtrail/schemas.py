"""Explicit schemas, so that no text source is scanned twice to infer one."""

from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def _fields(**types):
    return StructType([StructField(name, kind(), True) for name, kind in types.items()])


TAGS = _fields(id=LongType, tool_id=LongType, bundle_id=StringType,
               refers_to_object_id=LongType, created=LongType)

EDGES = _fields(src=LongType, dst=LongType)



def _list(**types):
    return ArrayType(_fields(**types))


def _pages(**lists):
    """A page: its lists of records, and the figures it declares."""
    return StructType([*[StructField(n, t, True) for n, t in lists.items()],
                       *_fields(total=StringType, stat=StringType)])


# Fields of the dumped records. Numbers may be written as text and are read so.
_SITE = dict(id=StringType, name=StringType, count_objects=StringType, count_rooms=StringType,
             count_spots=StringType)
_ROOM = dict(id=StringType, name=StringType, floor=StringType, count_objects=StringType,
             count_spots=StringType)
_SPOT = dict(id=StringType, name=StringType, description=StringType, room_id=StringType,
             count_objects=StringType)
_NAMED = dict(id=StringType, name=StringType)

SITE_PAGES = _pages(sites=StructType([StructField("site", _list(**_SITE))]))
ROOM_PAGES = _pages(rooms=StructType([StructField("room", _list(**_ROOM))]))
SPOT_PAGES = _pages(spots=StructType([StructField("spot", _list(**_SPOT))]))
DEPARTMENT_PAGES = _pages(departments=_list(**_NAMED))
TYPE_PAGES = _pages(types=_list(**_NAMED))
EXHIBITION_PAGES = _pages(exhibitions=_list(id=StringType, title=StringType, date_start=StringType,
                                            date_end=StringType))
OBJECT_PAGES = _pages(objects=_list(
    id=StringType, title=StringType, date=StringType, department_id=StringType, type=StringType,
    type_id=StringType, is_loan_object=StringType))
MEMBER_PAGES = StructType([StructField("exhibition_id", StringType()),
                           StructField("objects", _list(id=StringType))])

# Attributes a location row hands to the tags it is attached to.
LOCATION_COLUMNS = ["room_floor", "room_id", "room_name", "spot_id", "spot_name",
                    "spot_description", "room_count_objects", "room_count_spots",
                    "spot_count_objects"]

# Fixed value: marks "no metadata" in numeric columns.
NO_META = -9999
