import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

import pytest

from skyloom.sources import fits, tap


def test_pages_over_http_with_a_failure():
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            text = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["QUERY"][0]
            asked.append(text)
            if len(asked) == 2:
                return self.send_error(503)
            after = int(text.split("id > ")[1].split(" ")[0]) if "id > " in text else -1
            ids = [i for i in range(7) if i > after][:3]
            body = fits.write_votable({"id": ids, "name": [f"n<{i}" for i in ids]})
            self.send_response(200), self.end_headers(), self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        fetch = tap.http(f"http://127.0.0.1:{server.server_port}/tap", 10)
        got = [(list(p["id"]), list(p["name"]), after) for p, after in tap.pages(fetch, ["id", "name"], "t", "id", 3, where=["x < 1"], sleep=lambda _: None)]
    finally:
        server.shutdown()
    assert [g[0] for g in got] == [[0, 1, 2], [3, 4, 5], [6]] and got[0][1] == ["n<0", "n<1", "n<2"] and got[-1][2] == 6
    assert asked[0] == "SELECT TOP 3 id, name FROM t WHERE x < 1 ORDER BY id" and asked[1] == asked[2] == "SELECT TOP 3 id, name FROM t WHERE x < 1 AND id > 2 ORDER BY id"


def test_text():
    assert tap.inner_join(["a"], ["x", "y", "z"], "k") == "SELECT a FROM x JOIN y ON y.k = x.k JOIN z ON z.k = x.k" and tap.literal("o'b") == "'o''b'"
    with pytest.raises(OSError):
        list(tap.pages(lambda _: (_ for _ in ()).throw(OSError("x")), ["a"], "t", "a", 3, times=2, sleep=lambda _: None))
