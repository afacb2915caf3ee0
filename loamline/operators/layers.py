"""Architectural layers of modules: by path, by weighted signals in the text, and by place in the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.operators import graph

#: Layers that signals speak for; of equal scores the first in this order wins.
LAYERS = ("controller", "service", "repository", "model", "utility", "config")
# What a text holds, the layer that it speaks for, and by how much.
SIGNALS = (
    ("#[tauri::command]", "controller", 4),
    ("CallToolResult", "controller", 4),
    ("#[get(", "controller", 3),
    ("#[post(", "controller", 3),
    ("#[put(", "controller", 3),
    ("#[delete(", "controller", 3),
    ("#[derive(Args", "controller", 3),
    ("#[derive(Subcommand", "controller", 3),
    ("#[command(", "controller", 3),
    ("axum::Router", "controller", 3),
    ("axum::extract", "controller", 3),
    ("actix_web::web", "controller", 3),
    ("HttpResponse", "controller", 2),
    ("@app.route(", "controller", 3),
    ("@app.get(", "controller", 3),
    ("@app.post(", "controller", 3),
    ("@router.", "controller", 3),
    ("APIRouter", "controller", 3),
    ("def get(self, request", "controller", 3),
    ("def post(self, request", "controller", 3),
    ("@api_view", "controller", 3),
    ("class Meta:\n        model", "controller", 2),
    ("app.get(", "controller", 3),
    ("app.post(", "controller", 3),
    ("app.put(", "controller", 3),
    ("app.delete(", "controller", 3),
    ("router.get(", "controller", 3),
    ("router.post(", "controller", 3),
    ("fastify.get(", "controller", 3),
    ("fastify.post(", "controller", 3),
    ("@Controller(", "controller", 4),
    ("@Get(", "controller", 3),
    ("@Post(", "controller", 3),
    ("@Put(", "controller", 3),
    ("@Delete(", "controller", 3),
    ("@Patch(", "controller", 3),
    ("export default function Page", "controller", 3),
    ("getServerSideProps", "controller", 3),
    ("getStaticProps", "controller", 3),
    ("export async function GET(", "controller", 4),
    ("export async function POST(", "controller", 4),
    ("NextRequest", "controller", 3),
    ("NextResponse", "controller", 3),
    ("useState(", "controller", 2),
    ("useEffect(", "controller", 2),
    ("return (<", "controller", 2),
    ("return (\n", "controller", 1),
    ("React.FC", "controller", 2),
    ("JSX.Element", "controller", 2),
    ("defineComponent(", "controller", 3),
    ("<script setup", "controller", 3),
    ("defineProps(", "controller", 3),
    ("<template>", "controller", 3),
    ("createApp(", "controller", 2),
    ("@Component(", "controller", 5),
    ("@NgModule(", "controller", 3),
    ("@Directive(", "controller", 3),
    ("@Pipe(", "controller", 2),
    ("Astro.props", "controller", 3),
    ("Astro.request", "controller", 3),
    ("Astro.redirect(", "controller", 3),
    ("http.HandleFunc(", "controller", 3),
    ("gin.Context", "controller", 3),
    ("echo.Context", "controller", 3),
    ("fiber.Ctx", "controller", 3),
    ("chi.Router", "controller", 3),
    ("http.Handler", "controller", 2),
    ("func (w http.ResponseWriter", "controller", 4),
    ("extends StatelessWidget", "controller", 3),
    ("extends StatefulWidget", "controller", 3),
    ("Widget build(", "controller", 3),
    ("Route(", "controller", 2),
    ("shelf.Router", "controller", 3),
    ("onRequest(", "controller", 3),
    ("@RestController", "controller", 4),
    ("@GetMapping", "controller", 3),
    ("@PostMapping", "controller", 3),
    ("@PutMapping", "controller", 3),
    ("@DeleteMapping", "controller", 3),
    ("@RequestMapping", "controller", 3),
    ("#[async_trait]", "service", 2),
    ("impl ", "service", 1),
    ("class ", "service", 1),
    ("@Injectable(", "service", 4),
    ("@Injectable({", "service", 4),
    ("providedIn:", "service", 3),
    ("extends ChangeNotifier", "service", 4),
    ("extends Bloc<", "service", 4),
    ("extends Cubit<", "service", 4),
    ("StateNotifierProvider", "service", 3),
    ("riverpod", "service", 2),
    ("FutureProvider", "service", 3),
    ("StreamProvider", "service", 3),
    ("export function use", "service", 3),
    ("export const use", "service", 3),
    ("type Service struct", "service", 3),
    ("@Service", "service", 4),
    ("@Component", "service", 3),
    ("@Transactional", "service", 2),
    ("diesel::", "repository", 4),
    ("sqlx::", "repository", 4),
    ("sea_orm::", "repository", 4),
    ("#[derive(Queryable", "repository", 4),
    ("#[derive(Insertable", "repository", 4),
    ("session.query(", "repository", 4),
    ("cursor.execute(", "repository", 4),
    ("objects.filter(", "repository", 3),
    ("objects.get(", "repository", 3),
    ("objects.create(", "repository", 3),
    ("objects.all(", "repository", 3),
    ("tortoise.models", "repository", 3),
    ("prisma.", "repository", 4),
    ("sequelize.", "repository", 4),
    ("mongoose.", "repository", 4),
    ("mongoose.model(", "repository", 4),
    ("knex(", "repository", 3),
    ("typeorm", "repository", 3),
    ("drizzle(", "repository", 4),
    ("getRepository(", "repository", 3),
    ("@Entity(", "repository", 3),
    ("sql.DB", "repository", 3),
    ("gorm.", "repository", 4),
    ("gorm.Model", "repository", 4),
    ("sqlx.DB", "repository", 3),
    ("extends DatabaseAccessor", "repository", 4),
    ("@DriftDatabase(", "repository", 4),
    ("@dao", "repository", 4),
    ("FloorDatabase", "repository", 4),
    ("openDatabase(", "repository", 3),
    ("Isar.open(", "repository", 3),
    ("@Repository", "repository", 4),
    ("JpaRepository", "repository", 4),
    ("CrudRepository", "repository", 4),
    ("EntityManager", "repository", 3),
    ("@Query(", "repository", 3),
    ("SELECT ", "repository", 2),
    ("INSERT INTO", "repository", 2),
    ("CREATE TABLE", "repository", 3),
    ("#[derive(Serialize", "model", 2),
    ("#[derive(Deserialize", "model", 2),
    ("pub struct ", "model", 1),
    ("pub enum ", "model", 1),
    ("class Meta:", "model", 3),
    ("(BaseModel):", "model", 3),
    ("(models.Model):", "model", 4),
    ("@dataclass", "model", 3),
    ("@attr.s", "model", 3),
    ("Field(", "model", 1),
    ("z.object(", "model", 3),
    ("z.string(", "model", 2),
    ("export interface ", "model", 2),
    ("export type ", "model", 2),
    ("new Schema(", "model", 3),
    ("@Schema(", "model", 3),
    ("@Prop(", "model", 2),
    ("`json:\"", "model", 2),
    ("`xml:\"", "model", 2),
    ("`db:\"", "model", 2),
    ("@JsonSerializable(", "model", 4),
    ("@freezed", "model", 4),
    ("factory ", "model", 1),
    ("fromJson(", "model", 2),
    ("toJson(", "model", 2),
    ("@Entity", "model", 4),
    ("@Data", "model", 3),
    ("@Table(", "model", 3),
    ("@Column(", "model", 2),
    ("pub fn ", "utility", 1),
    ("pub(crate) fn ", "utility", 1),
    ("pub(super) fn ", "utility", 1),
    ("function ", "utility", 1),
    ("def ", "utility", 1),
    ("func ", "utility", 1),
    ("dotenv", "config", 3),
    ("env::", "config", 2),
    ("process.env.", "config", 2),
    ("os.environ", "config", 2),
    ("os.Getenv(", "config", 2),
    ("Platform.environment", "config", 2),
    ("defineConfig(", "config", 3),
    ("vite.config", "config", 3),
    ("next.config", "config", 3),
    ("nuxt.config", "config", 3),
    ("astro.config", "config", 3),
    ("angular.json", "config", 3),
)
# Folders that speak for a layer, by two each; ends of paths of settings and of entry points.
FOLDERS = {
    "controller": ("controllers", "controller", "routes", "routers", "handlers", "views", "endpoints", "api", "commands", "tools", "pages"),
    "service": ("services", "service", "usecases", "use_cases", "domain", "business", "logic"),
    "repository": ("repositories", "repository", "repos", "dao", "dal", "data", "db", "database", "persistence", "migration", "migrations"),
    "model": ("models", "model", "entities", "entity", "schemas", "schema", "types", "dto", "dtos", "proto"),
    "utility": ("utils", "util", "helpers", "helper", "common", "shared", "lib", "middleware"),
    "config": ("config", "configuration", "settings"),
}
FOLDER_BONUS = 2
CONFIG_ENDS = ("config.py", "config.js", "config.ts", "config.rs", "config.toml", "config.yaml", "config.yml")
ENTRY_ENDS = ("main.rs", "build.rs", "lib.rs")


def by_path(path: Column) -> Column:
    """The layer that a path alone decides: tests, settings, entry points; else null."""
    low = F.lower(path)
    ends = lambda xs: low.rlike("(" + "|".join(x.replace(".", r"\.") for x in xs) + ")$")
    return F.when(low.contains("test") | low.contains("spec"), "test").when(low.contains(".env") | ends(CONFIG_ENDS), "config").when(ends(ENTRY_ENDS), "utility")


def _how_many(parts: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.filter(parts, lambda p: p.isin(*names)))


def scores(path: Column, text: Column) -> dict[str, Column]:
    """For each layer the weights of the signals that a text holds, and two for each folder of the path that speaks for it."""
    parts = F.split(F.lower(path), "/")
    out = {}
    for layer in LAYERS:
        total = FOLDER_BONUS * _how_many(parts, FOLDERS[layer])
        for pattern, own, weight in SIGNALS:
            if own == layer:
                total = total + F.when(text.contains(pattern), weight).otherwise(0)
        out[layer] = total
    return out


def layer_scores(files: DataFrame) -> DataFrame:
    """(path, layer, score) of the layers with a score that isn't zero; files: (path, text).  A null text has no signals."""
    found = scores(F.col("path"), F.coalesce("text", F.lit("")))
    each = F.array(*[F.struct(F.lit(k).alias("layer"), v.cast("int").alias("score")) for k, v in found.items()])
    return files.select("path", F.explode(each).alias("s")).select("path", "s.*").filter("score <> 0")


def classify(files: DataFrame) -> DataFrame:
    """(path, layer): by path, else the layer of the highest positive score, else unknown."""
    found = scores(F.col("path"), F.coalesce("text", F.lit("")))
    best = F.array_max(F.array(*[F.struct(v.cast("int").alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("layer")) for i, (k, v) in enumerate(found.items())]))
    rows = files.select("path", by_path(F.col("path")).alias("fixed"), best.alias("best"))
    return rows.select("path", F.coalesce("fixed", F.when(F.col("best.score") > 0, F.col("best.layer")), F.lit("unknown")).alias("layer"))


def refine(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, layer): unknown modules by fan-in and fan-out against twice the median fan-in (three at least); others as they are.

    imports: (src, dst) between modules.
    """
    c = graph.coupling(modules, imports)
    high = graph.adaptive_threshold(c)
    fi, fo, t = F.col("fan_in"), F.col("fan_out"), F.col("threshold")
    layer = F.when((fi >= t) & (fo <= 1), "model").when(fi >= t, "utility").when((fo >= t) & (fi <= 1), "controller").when((fo > fi) & (fo >= 2), "service").otherwise("unknown")
    # The threshold is one row.
    rows = modules.join(c, "path").join(F.broadcast(high))
    return rows.select("path", F.when(F.col("layer") == "unknown", layer).otherwise(F.col("layer")).alias("layer"))
