"""Small sources in several languages for the readers of program text."""

SOURCES = [
    ("app/orders.py", "from app.store import save\nimport app.util as util\n\nclass Base:\n    pass\n\nclass Orders(Base):\n    def total(self):\n        return util.clean(1)\n\nrouter = Router(prefix='/v1')\n\n@router.get('/orders')\nasync def listing():\n    name = request.args['q']\n    text = name + '!'\n    db.execute('SELECT * FROM orders JOIN items ON 1')\n    os.system(text)\n"),
    ("app/store.py", "def save(row):\n    return row\n"),
    ("app/util.py", "def clean(x):\n    # def hidden(): no\n    return '''def inner(): no'''\n"),
    ("web/server.js", "const { check } = require('./auth')\nconst BASE = '/api'\nfunction start() {}\nrouter.post('/login', check)\napp.get(BASE + '/items', start)\nconst user = async (id) => id\neval(input)\nserver.route({ method: ['GET', 'POST'], url: '/both' })\n"),
    ("web/paths.js", "export const SHOP = '/shop'\n"),
    ("web/shop.js", "app.get(SHOP + '/cart', list)\n"),
    ("web/auth.js", "export function check(a) { return verify(a) }\nclass Guard extends Base {}\n"),
    ("web/cats.ts", "@Controller('cats')\nexport class Cats {\n  @Get(':id')\n  one() {}\n}\n"),
    ("cmd/main.go", 'import (\n  "fmt"\n)\nfunc (s *Server) Run() {}\nfunc main() {\n  v1 := r.Group("/v1")\n  v1.GET("/ping", Run)\n  exec.Command("ls")\n}\n'),
    ("src/lib.rs", 'pub fn parse(x: u8) {}\nstruct Token;\n#[get("/health")]\nfn health() {}\nfn app() { Router::new().route("/t", post(parse)) }\n'),
    ("src/Users.java", '@RequestMapping("/users")\npublic class Users extends Base {\n  @GetMapping("/{id}")\n  public User one() { return find(); }\n}\n'),
    ("src/ItemsController.cs", '[Route("api/[controller]")]\npublic class ItemsController : Base {\n  [HttpGet("{id}")]\n  public int One() { return 1; }\n}\n'),
    ("routes/web.php", "<?php\nRoute::prefix('admin')->group(function () {\n  Route::get('/users', 'index');\n});\n"),
    ("config/routes.rb", "resources :photos\nget '/about' do\nend\n"),
    ("db/schema.sql", "CREATE TABLE IF NOT EXISTS orders (id int);\nINSERT INTO items VALUES (1);\n-- DROP TABLE gone\n"),
    ("views/urls.py", "urlpatterns = [\n  path('home/', index),\n  path('shop/', include('shop.urls')),\n]\nrouter.register('books', Books)\n"),
]



REPORTS = [
    ("semgrep", '{"results":[{"check_id":"a.b","path":"x.py","start":{"line":3},"extra":{"severity":"ERROR","message":"m"}}]}'), ("gitleaks", '[{"RuleID":"key","File":"k.txt","StartLine":1,"Description":"d"}]'),
    ("bandit", '{"results":[{"test_id":"B1","filename":"y.py","line_number":9,"issue_severity":"LOW","issue_text":"t"}]}'), ("trivy", '{"Results":[{"Target":"go.mod","Vulnerabilities":[{"VulnerabilityID":"V-1","Severity":"HIGH","Title":"v"}]},{"Target":"none"}]}'),
    ("osv", '{"results":[{"source":{"path":"p.lock"},"packages":[{"vulnerabilities":[{"id":"O-1","summary":"s"},{"id":"O-2","summary":"s"}]}]}]}'), ("bandit", "not json"), ("other", "{}"),
]
MANIFESTS = [
    ("package.json", '{"dependencies":{"left":"1","right":"2"},"devDependencies":{"test":"3"}}'), ("requirements-dev.txt", "alpha==1\n# no\nbeta>=2\nalpha\n"), ("go.mod", "module m\nrequire (\n  host.org/x/y v1.2\n)\n"), ("Cargo.toml", '[package]\nname = "me"\n[dependencies]\nserde = "1"\n'),
    ("sub/pom.xml", "<dependency><artifactId>core</artifactId></dependency>"), ("Gemfile", "gem 'rails'\n"), ("readme.md", "gem 'no'"),
]
