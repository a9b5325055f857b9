"""Raw drops that tests put down."""

from __future__ import annotations

from pathlib import Path

from weirline.config import RAW_PARTITIONS, CurateRules

HEADER = ",".join(CurateRules().raw_columns)
PARTITIONS = RAW_PARTITIONS

# Eight clean customers; the counts per region are 4, 2, 1 and 1.
CLEAN = [
    "101,Ada,Quill,ada@mail.test,900-11-0001,us-east-1,2021-03-04,12.50",
    "102,Ben,Rook,ben@mail.test,900-11-0002,us-west-2,2021-04-05,99.99",
    "103,Cleo,Sable,cleo@mail.test,900-11-0003,us-east-1,2021-05-06,1000.00",
    "104,Dov,Thorn,dov@mail.test,900-11-0004,eu-west-1,2021-06-07,0.25",
    "105,Eve,Umber,eve@mail.test,900-11-0005,us-east-1,2021-07-08,450.75",
    "106,Fay,Vale,fay@mail.test,900-11-0006,ap-southeast-1,2021-08-09,3.00",
    "107,Gus,Wren,gus@mail.test,900-11-0007,us-east-1,2021-09-10,70.10",
    "108,Hal,Yew,hal@mail.test,900-11-0008,us-west-2,2021-10-11,5.05",
]


def drop(root: Path, name: str, lines: list[str], header: str = HEADER, partition: str = "year=2026/month=04") -> Path:
    """Put a CSV file where a producer would."""
    folder = root / partition if partition else root
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text("\n".join([header, *lines]) + "\n")
    return path
