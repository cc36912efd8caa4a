"""Sample rows shared by the tests: a tree nursery, made up for them.

The later file goes on behind the marks of the first; the invalid one has a sound row, a
missing customer, a quantity below zero, and a row without product whose date is none.
"""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

SALES_HEADER = "id,product_id,customer_id,quantity,amount,sale_date,region"
SALES = [
    "s-01,oak,ada,4,84.00,2024-01-02,Coast",
    "s-02,elm,bo,1,19.50,2024-01-04,Hills",
    "s-03,oak,cy,6,126.00,2024-01-05,Valley",
    "s-04,fir,ada,2,31.20,2024-01-09,Coast",
    "s-05,elm,dee,3,58.50,2024-01-11,Delta",
    "s-06,fir,bo,5,78.00,2024-01-14,Hills",
    "s-07,oak,eve,1,21.00,2024-01-17,Valley",
    "s-08,elm,cy,2,39.00,2024-01-19,Coast",
    "s-09,fir,dee,8,124.80,2024-01-22,Delta",
    "s-10,oak,eve,7,147.00,2024-01-25,Valley",
]
SALES_LATER = [
    "s-11,oak,ada,3,63.00,2024-01-26,Coast",
    "s-12,elm,cy,9,175.50,2024-01-28,Valley",
    "s-13,fir,eve,2,31.20,2024-01-30,Delta",
]
SALES_INVALID = [
    "x-0,oak,ada,4,84.00,2024-01-26,Coast",
    "x-1,elm,,2,39.00,2024-01-27,Hills",
    "x-2,oak,cy,-6,126.00,2024-01-28,Valley",
    "x-3,,ada,2,31.20,someday,Coast",
]
PRODUCTS_HEADER = "product_id,product_name,category,price,valid_from"
PRODUCTS = [
    "oak,Oak sapling,Hardwood,21.00,2023-12-01",
    "elm,Elm sapling,Hardwood,19.50,2023-12-01",
    "fir,Fir sapling,Conifer,15.60,2023-12-01",
]
CUSTOMERS_HEADER = "customer_id,customer_name,email,segment,valid_from"
CUSTOMERS = [
    "ada,Ada Quill,quill@nursery.example,Trade,2023-12-01",
    "bo,Bo Marsh,marsh@garden.example,Private,2023-12-01",
    "cy,Cy Fenn,fenn@nursery.example,Trade,2023-12-01",
    "dee,Dee Holt,holt@garden.example,Private,2023-12-01",
    "eve,Eve Lark,lark@nursery.example,Trade,2023-12-01",
]


def write_csv(path: Path, header: str, rows: list[str]) -> str:
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def day(n: int, month: int = 1, hour: int = 0) -> datetime:
    return datetime(2024, month, n, hour)
