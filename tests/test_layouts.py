import random

import pytest

from feedmill.functions.html import links, tokens
from feedmill.sources import layouts

RULES = {x.layout: layouts.asdict(x) for x in layouts.SITES}


def found(html, layout):
    return [(title, url, str(day)) for _, title, url, _, day in layouts.items(html, RULES[layout])]


def test_tokens_of_odd_markup():
    assert list(tokens("1 < 2<b C=d e='f g' h c=x>y</B><!-- <a> --><?x?><br/>")) == [("text", "1 ", {}), ("text", "<", {}), ("text", " 2", {}), ("open", "b", {"c": "d", "e": "f g", "h": ""}), ("text", "y", {}), ("close", "b", {}), ("open", "br", {})]
    assert list(tokens('<script>if (a<b) "</p>"</script >z')) == [("open", "script", {}), ("text", 'if (a<b) "</p>"', {}), ("close", "script", {}), ("text", "z", {})]
    assert list(tokens("<a href = x =y>")) == [("open", "a", {"href": "x", "y": ""})]
    for cut in ("<", "<a", '<a href="x', "<!--", "<!doctype", "</", "<script>a<b", "<a b='"):
        assert all(kind == "text" or value in ("a", "script") for kind, value, _ in tokens(cut))


def test_text_survives_any_well_formed_nesting():
    rng = random.Random(4)
    for _ in range(200):
        words, parts, depth = [], [], []
        for _ in range(rng.randint(1, 30)):
            turn = rng.random()
            if turn < 0.4:
                words.append(f"w{rng.randint(0, 99)} ")
                parts.append(words[-1])
            elif turn < 0.7:
                depth.append(rng.choice(["p", "div", "b"]))
                parts.append(f'<{depth[-1]} id="{rng.randint(0, 9)}">')
            elif depth:
                parts.append(f"</{depth.pop()}>")
        got = list(tokens("".join(parts)))
        assert "".join(v for k, v, _ in got if k == "text") == "".join(words)
        assert sum(k == "open" for k, _, _ in got) == sum(p.startswith("<") and p[1] != "/" for p in parts)


def test_links_with_broken_nesting():
    html = "<ul><li><a href=1>one<li><a href=2>two</b></a><span>x</span></ul><a href=3>three <b>four</b></a> <i>y"
    assert [(a["href"], t, plain, after) for a, t, plain, after in links(html)] == [("1", "one", False, []), ("2", "two", False, [("span", "x")]), ("3", "three four", False, [("i", "y")])]
    assert [a["href"] for a, *_ in links(html, "li")] == ["1", "2"]


def test_news_of_a_channel():
    page = "".join(
        f'<a class=x href="https://finance.cctv.com/{rest}">{title}</a>'
        for rest, title in [("2024/09/12/A1.shtml", "央行开展操作"), ("2024/09/12/VIDE12.shtml", "视频专题节目"), ("2024/09/12/index.shtml", "首页首页"), ("2024/09/12/A1.shtml", "重复的条目"), ("2013/09/12/A2.shtml", "旧的栏目"), ("2024/09/13/A3.shtml", "短"), ("2024/09/14/A4.shtml", "带&nbsp;实体 的标题")]
    )
    assert found(page, "cctv-finance") == [("央行开展操作", "https://finance.cctv.com/2024/09/12/A1.shtml", "2024-09-12"), ("带 实体 的标题", "https://finance.cctv.com/2024/09/14/A4.shtml", "2024-09-14")]


def test_policies_take_the_date_beside_them():
    page = '<li><a href="./zhengce/content_1.htm" target=_blank> 关于金融支持实体的举措 </a> <span> 2024-9-1 </span></li><li><a href="/other.htm">不是政策文件的页面</a><span>2024-09-02</span></li><a href="/content_2.htm">不在列表中的政策文件</a><span>2024-09-03</span><li><a href="http://x/content_3.htm">没有日期的政策文件页</a></li><li><a href="/content_4.htm">月份写错的政策文件页</a><span>2024-13-01</span>'
    assert found(page, "govcn-policy") == [("关于金融支持实体的举措", "https://www.gov.cn/zhengce/content_1.htm", "2024-09-01"), ("没有日期的政策文件页", "http://x/content_3.htm", "None"), ("月份写错的政策文件页", "https://www.gov.cn/content_4.htm", "None")]


def test_words_and_attributes_choose():
    page = '<a href="/money/2024-09-12/doc.shtml">银行理财收益率企稳回升</a><a href="/money/2024-09-12/x.shtml">某明星出席活动引关注热议</a><a href="javascript:void(0)">银行理财收益率企稳回升</a>'
    assert found(page, "sina-money") == [("银行理财收益率企稳回升", "https://finance.sina.com.cn/money/2024-09-12/doc.shtml", "2024-09-12")]
    page = '<a title="消费贷贴息扩围 银行加码普惠金融" href="/article/20240911/1.html"><img></a><a href="/article/20240911/2.html" title="与此无关的一条长长的新闻">占位</a>'
    assert found(page, "21jingji") == [("消费贷贴息扩围 银行加码普惠金融", "https://www.21jingji.com/article/20240911/1.html", "2024-09-11")]


def test_limits_are_for_a_page():
    page = "".join(f'<a href="/{i}">银行理财收益率第{i:04d}期</a>' for i in range(50))
    assert len(found(page, "sina-money")) == 20


@pytest.mark.parametrize("most", [layouts.BROADCAST_RULES, 0])
def test_pages_of_all_layouts_in_one_table(spark, monkeypatch, most):
    monkeypatch.setattr(layouts, "BROADCAST_RULES", most)
    pages = [(1, '<a href="https://finance.cctv.com/2024/09/12/A.shtml">央行开展操作', "cctv-finance"), (2, '<li><a href="/content_1.htm">关于金融支持实体的举措</a><span>2024-09-01', "govcn-policy"), (3, None, "sina-money"), (4, "", "21jingji"), (5, "<a href=x>y</a>", "unknown"), (None, '<a href="/q" title="LPR连续三月按兵不动了">', "21jingji")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page long, html string, layout string, url string")
    got = layouts.site_items(frame, layouts.rules_table(spark)).collect()
    assert sorted((r.page or 0, r.position, r.title, str(r.day)) for r in got) == [(0, 0, "LPR连续三月按兵不动了", "None"), (1, 0, "央行开展操作", "2024-09-12"), (2, 0, "关于金融支持实体的举措", "2024-09-01")]
    assert layouts.site_items(frame.limit(0), layouts.rules_table(spark)).count() == 0
