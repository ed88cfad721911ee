"""The scanned pages that the expected results of the golden tests belong to."""

COLUMNS = "level page_num block_num par_num line_num word_num left top width height conf text".split()
SCHEMA = ", ".join(f"{c} bigint" for c in COLUMNS[:10]) + ", conf double, text string"

ROWS = """\
1,1,0,0,0,0,0,0,300,400,-1,
2,1,1,0,0,0,20,20,110,90,-1,
3,1,1,1,0,0,20,20,180,30,-1,
4,1,1,1,1,0,20,20,110,10,-1,
5,1,1,1,1,1,20,20,30,10,96.063751,The
5,1,1,1,1,2,60,20,50,10,95.965691,(quick)
4,1,1,1,2,0,20,40,200,10,-1,
5,1,1,1,2,1,20,40,70,10,95.835831,[brown]
5,1,1,1,2,2,100,40,30,10,94.899742,fox
5,1,1,1,2,3,140,40,60,10,96.683357,jumps!
3,1,1,2,0,0,20,80,90,30,-1,
4,1,1,2,1,0,20,80,80,10,-1,
5,1,1,2,1,1,20,80,40,10,96.912064,Over
5,1,1,2,1,2,40,80,30,10,96.887390,the
4,1,1,2,2,0,20,100,100,10,-1,
5,1,1,2,2,1,20,100,60,10,90.893219,<lazy>
5,1,1,2,2,2,90,100,30,10,96.538940,dog
1,2,0,0,0,0,0,0,300,400,-1,
2,2,1,0,0,0,20,20,110,90,-1,
3,2,1,1,0,0,20,20,180,30,-1,
4,2,1,1,1,0,20,20,110,10,-1,
5,2,1,1,1,1,20,20,30,10,96.063751,The
5,2,1,1,1,2,60,20,50,10,95.965691,~groovy
4,2,1,1,2,0,20,40,200,10,-1,
5,2,1,1,2,1,20,40,70,10,95.835831,minute!
5,2,1,1,2,2,100,40,30,10,94.899742,dog
5,2,1,1,2,3,140,40,60,10,96.683357,bounds
3,2,1,2,0,0,20,80,90,30,-1,
4,2,1,2,1,0,20,80,80,10,-1,
5,2,1,2,1,1,20,80,40,10,96.912064,UPON
5,2,1,2,1,2,40,80,30,10,96.887390,the
4,2,1,2,2,0,20,100,100,10,-1,
5,2,1,2,2,1,20,100,60,10,90.893219,sleepy
5,2,1,2,2,2,90,100,30,10,96.538940,fox
"""


def table(spark):
    rows = [line.split(",") for line in ROWS.splitlines()]
    return spark.createDataFrame([(*map(int, r[:10]), float(r[10]), r[11]) for r in rows], SCHEMA)
