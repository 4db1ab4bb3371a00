from plumbline.extract import go_units as G

SOURCE = """package p

import "fmt"

type Box[T any] struct {
	n int
}

type (
	Shape interface {
		Area() float64
	}
	Alias = int
)

func (b *Box[T]) Run(x, y int, f func(int) bool) (int, error) {
	if x > 0 && f(x) {
		b.n++
	} else if y > 0 {
		b.m[x] = b.size
	} else {
		b.log.Warn("a")
	}
	switch x {
	case 1:
		for i := range items {
			go b.tick(i)
		}
	case 2:
	default:
	}
	b.n, b.k = b.get(), len(b.rest)
	return helper(x), nil
}

func init() {}

func init() {
	a := func() {
		if q || r {
			fmt.Println("}")
		}
	}
	a()
}
"""


def test_go():
    u = {x["id"].removeprefix("a.go::"): x for x in G.units(SOURCE, "a.go")}
    assert list(u) == ["Box", "Shape", "init", "init_1", "Box::Run"]
    run, closure = u["Box::Run"], u["init_1"]
    assert (run["kind"], run["parent"], run["params"], run["start_line"], run["end_line"]) == ("Method", "a.go::Box", 3, 16, 34)
    assert run["branches"] == 1 + 1 + 1 + 2 + 1 and run["cognitive_complexity"] == 1 + 1 + 1 + 1 + 1 + 2
    assert run["max_scope_lines"] == 8 and closure["branches"] == 2 and closure["cognitive_complexity"] == 2
    assert run["calls"] == ["f", "b.log.Warn", "b.tick", "b.get", "helper"] and closure["calls"] == ["fmt.Println", "a"]
    assert run["writes"] == ["self.n", "self.k"] and run["reads"] == ["self.size", "self.log", "self.tick", "self.rest"]


def test_generated_and_broken():
    assert G.units("// Code generated by x. DO NOT EDIT.\n\npackage p\nfunc f() {}", "a.go") == [] and G.units(SOURCE, "a.pb.go") == []
    assert G.units("package p\nfunc f( {", "a.go") == []
