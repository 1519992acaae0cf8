"""Every kind of credential reaches the registered query."""

import base64

from netloom.plans import entities


def test_all_kinds(spark, tmp_path):
    blob = lambda x: base64.b64encode(x).decode()
    texts = ["PASS hunter2", "a1 LOGIN joe pw", f"AUTH PLAIN\n{blob(b'joe' + bytes(1) + b'secret')}", f"GET /\nAuthorization: Basic {blob(b'u:p')}", "prose"]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in entities.queries()["x14_credentials"](spark, str(tmp_path)).collect()}
    users = {(i, "FTP-USER", "USER web") for i in range(5)}
    assert found == users | {(0, "FTP-PASS", "PASS hunter2"), (1, "IMAP-LOGIN", "a1 LOGIN joe pw"), (2, "SMTP-AUTH", "joe:secret"), (3, "HTTP-BasicAuth", "u:p")}
