import pytest

from flowguard import vocabulary as V
from flowguard.sources import datasets as D

FLOW = " Flow Duration,Total Length of Fwd Packets, Total Fwd Packets,Average Packet Size,Destination Port,Label\n"


def test_training_and_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" connections ,bytes,packets,packet_size,ports,label\n1,100,2,50,1,0\n2,inf,x,5,,1\n")
    rows = D.load_training(spark, str(tmp_path / "t.csv")).orderBy("connections").collect()
    assert [r.y for r in rows] == [0, 1]
    assert (rows[1].bytes, rows[1].packets, rows[1].ports, rows[0].bytes_per_packet) == (0.0, 0.0, 0.0, 50.0)
    assert D.load_inference(spark, str(tmp_path / "t.csv")).columns == V.FEATURES
    (tmp_path / "text.csv").write_text("connections,bytes,packets,packet_size,ports,Label\n1,1,1,1,1, benign\n1,1,1,1,1,DoS\n1,1,1,1,1,0.0\n")
    text = D.load_training(spark, str(tmp_path / "text.csv"))
    assert sorted(r.y for r in text.collect()) == [0, 1, 1]
    assert text.select("row_id").distinct().count() == 3 and sorted(text.collect()) == sorted(text.repartition(3).collect())
    (tmp_path / "bad.csv").write_text("connections,bytes,label\n1,2,0\n")
    with pytest.raises(ValueError):
        D.load_training(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "none.csv").write_text("connections,bytes,packets,packet_size,ports\n1,1,1,1,1\n")
    with pytest.raises(ValueError):
        D.load_training(spark, str(tmp_path / "none.csv"))


def test_folder_of_datasets(spark, tmp_path):
    (tmp_path / "a.csv").write_text(FLOW + "10,200,3,66.6,80,BENIGN\n")
    (tmp_path / "b.csv").write_text(FLOW.replace(",", ";") + "20;400; 6;70;443;DoS\n")
    wide = [str(i) for i in range(44)] + ["1"]
    (tmp_path / "c.csv").write_text(",".join(wide) + "\n" + ",".join(wide[:-1] + ["0"]) + "\n")
    (tmp_path / "d.csv").write_text("x,y\n1,2\n")
    (tmp_path / "e.txt").write_text("ignored")
    rows = sorted(tuple(r) for r in D.prepare_dataset(D.load_datasets(spark, str(tmp_path))).select(*V.BASE_FEATURES, "label", "target").collect())
    assert rows == [
        (1.0, 7.0, 16.0, 7.0, 3.0, "0", 0), (1.0, 7.0, 16.0, 7.0, 3.0, "1", 1),
        (10.0, 200.0, 3.0, 66.6, 80.0, "BENIGN", 0), (20.0, 400.0, 6.0, 70.0, 443.0, "DoS", 1),
    ]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "d.csv").write_text("x,y\n1,2\n")
    with pytest.raises(RuntimeError):
        D.load_datasets(spark, str(empty))
